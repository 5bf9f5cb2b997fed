import random
import re
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import url_rules as ur

URLS = [
    None, "", "no scheme/x", "http://", "http://net", "http://net/", "HTTPS://A.Example.NET/en/1?x#y", "http://example.net/en", "http://example.net/en/", "http://myexample.com/de/", "http://a.b.example.com/de/x",
    "http://example.com?/de/", "http://example.com#/de/", "ftp://x.org/fr/1", "http://org/fr/", "http://x.org/de/", "x://y://z.net/q", "http://ÄX.net/a", "http://user@x.net:80/", "http://notnet/", "://net/p", "http://a.net/\nen",
]


def brute(url):
    """(host, path, rule, verdict) by the contract."""
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for verdict, h, p in ur.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    return host, path, *(best or (None, "allow"))


def test_fixed_rules(spark):
    rows = [(i, u, "c") for i, u in enumerate(URLS)] + [(3, "http://a.net/x", "c")]
    d = spark.createDataFrame(rows, "page_id long, url string, host string").selectExpr("*", "1 AS path", "2 AS rule")
    out = ur.judge(d, []).collect()
    assert sorted((r["page_id"], *map(str, (r["host"], r["path"], r["rule"], r["verdict"]))) for r in out) == sorted((i, *map(str, brute(u))) for i, u, _ in rows)
    assert ur.judge(d.limit(0), []).count() == 0


def brute_rules(pages, labels, floor, confidence, max_len=3):
    """All token sets by enumeration; of those that pass, the ones no other is part of."""
    rows = [(set(t), labels[i]) for i, t in pages.items() if i in labels]
    counts = {}
    for tokens, bad in rows:
        for k in range(1, max_len + 1):
            for s in combinations(sorted(tokens), k):
                c = counts.setdefault(s, [0, 0])
                c[0] += 1
                c[1] += bad
    passed = {s: (n, b) for s, (n, b) in counts.items() if b >= floor and b / n >= confidence}
    return [ur.MinedRule(s, b / n, b) for s, (n, b) in passed.items() if not any(p in passed for k in range(1, len(s)) for p in combinations(s, k))]


def test_mined_rules_equal_enumeration(spark):
    rng = random.Random(8)
    pages, labels = [], []
    for i in range(300):
        host = rng.choice(["shop", "blog", "news"]) + ".site.test"
        path = "/" + rng.choice(["win", "read"]) + "/" + rng.choice(["casino", "garden"])
        bad = "casino" in path and "win" in path and rng.random() < 0.9 or rng.random() < 0.05
        pages.append((i, f"http://{host}{path}"))
        if i % 5:
            labels.append((i, int(not bad), 0))
    labels += [(None, 0, 0), (3, None, None)]
    p = spark.createDataFrame([*pages, (None, None), (301, "http://shop.site.test/win/casino")], "page_id long, url string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    tokens = {r["page_id"]: r["t"] for r in p.select("page_id", ur.tokens_column(ur.host_column(F.col("url")), ur.path_column(F.col("url"))).alias("t")).collect()}
    mined = ur.mine(p, lab, min_count=8, min_support=0.0, min_confidence=0.7)
    own = {i: int(q == 0) for i, q, _ in labels if i is not None and q is not None}
    want = brute_rules({i: tokens[i] for i, _ in pages}, own, 8, 0.7)
    assert {(r.tokens, r.support, round(r.confidence, 9)) for r in mined} == {(r.tokens, r.support, round(r.confidence, 9)) for r in want}
    assert any(set(r.tokens) == {"p:casino", "p:win"} for r in mined)
    out = {r["page_id"]: r for r in ur.judge(p, mined).collect()}
    for i, t in tokens.items():
        hit = any(set(r.tokens) <= set(t or ()) for r in mined)
        assert (out[i]["verdict"] == "block") == hit and (out[i]["mined_rule"] is not None) == hit


@pytest.mark.parametrize("width,max_len", [(12, 3), (3, 3), (4, 2), (2, 1), (5, 4)])
def test_random_token_sets_equal_enumeration(spark, monkeypatch, width, max_len):
    """Whole baskets and baskets cut into parts give the same rules."""
    monkeypatch.setattr(ur, "WIDTH", width)
    rng = random.Random(width * 10 + max_len)
    words = ["w%s" % c for c in "abcdefghij"]
    pages, labels = [], []
    for i in range(150):
        own = [w for w in words if rng.random() < 0.45]
        bad = {"wa", "wb"} <= set(own) or {"wc", "wd", "we"} <= set(own) or rng.random() < 0.15
        pages.append((i, "http://h/" + "/".join(own)))
        labels.append((i, int(not bad), 0))
    p, lab = spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    tokens = {r["page_id"]: r["t"] for r in p.select("page_id", ur.tokens_column(ur.host_column(F.col("url")), ur.path_column(F.col("url"))).alias("t")).collect()}
    mined = ur.mine(p, lab, min_count=6, min_support=0.0, min_confidence=0.75, max_len=max_len)
    want = brute_rules(tokens, {i: int(q == 0) for i, q, _ in labels}, 6, 0.75, max_len)
    assert {(r.tokens, r.support, round(r.confidence, 9)) for r in mined} == {(r.tokens, r.support, round(r.confidence, 9)) for r in want}


def test_long_urls_that_share_many_tokens(spark):
    """40 blocked URLs with 30 tokens in common, of which others have all but the last two."""
    common = "/".join("t%s" % chr(97 + i) * 2 for i in range(28))
    rows = [(i, f"http://one.test/{common}/" + ("yes/also" if i < 40 else "yes" if i < 70 else "also")) for i in range(100)]
    p = spark.createDataFrame([*rows, (1000, "http://x.test/" + "long/" * 50_000 + "yes/also")], "page_id long, url string")
    lab = spark.createDataFrame([(i, int(i >= 40), 0) for i in range(100)], "doc_id long, quality int, toxic int")
    mined = ur.mine(p, lab, min_count=8, min_support=0.002)
    assert {(r.tokens, r.support, r.confidence) for r in mined} == {(("p:also", "p:yes"), 40, 1.0)}
    assert {r["page_id"] for r in ur.judge(p, mined).filter("mined_rule IS NOT NULL").collect()} == {*range(40), 1000}


def test_nothing_to_mine(spark):
    none, lab = spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert ur.mine(none, lab) == [] and ur.filter_urls(none, lab).count() == 0
    one = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    assert ur.mine(one, spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int")) == []


def test_index_equals_a_scan():
    rng = random.Random(1)
    rules = [ur.MinedRule(tuple(sorted(rng.sample("abcdefgh", rng.randint(1, 3)))), rng.random(), 9) for _ in range(60)]
    index = ur.Index(rules)
    for _ in range(200):
        tokens = set(rng.sample("abcdefgh", rng.randint(0, 6)))
        assert index.match(tokens) == [k for k, r in enumerate(rules) if set(r.tokens) <= tokens]
