import math
import random
import statistics
import zlib
from collections import Counter

import numpy as np
import pytest

from palimpsest.llm import rule_ensemble as re_


def make(rng, n):
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice("the of and a river stone house water light near".split()) for _ in range(rng.randint(30, 200))]
        kind = rng.randrange(4)
        if kind == 0:
            words = [w + "###" for w in words]
        elif kind == 1:
            words = [w.upper() + "!!" for w in words]
        docs.append((i, " ".join(words)))
        labels.append((i, int(kind > 1)))
    return docs, labels


def test_rules_and_columns_agree(spark):
    docs, labels = make(random.Random(3), 300)
    docs += [(1000, None), (1001, ""), (1002, "\n \n"), (1003, "x" * 100_000), (None, docs[0][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "0 AS score", "'q' AS statistics", "1 AS held_out")
    lab = spark.createDataFrame([*labels, (None, 1), (4, None)], "doc_id long, quality int")
    model = re_.fit(d, lab, max_rows=200, trees=10)
    assert model.rules and all(1 <= len(r.terms) <= 6 for r in model.rules)
    x = np.array([re_.statistics(t or "") for _, t in docs])
    want = {i: s for (i, _), s in zip(docs, model.score(x))}
    out = re_.classify(d, lab, max_rows=200, trees=10).collect()
    assert len(out) == len(docs)
    for r in out:
        assert r["score"] == pytest.approx(want[r["doc_id"]]) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    truth = dict(labels)
    held = [r for r in out if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.95
    plan = re_.score_documents(d.select("text"), model)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_fit_is_bounded_and_blind_to_held_out_labels(spark):
    docs, labels = make(random.Random(5), 200)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    x, y = re_.labelled_statistics(d, lab, max_rows=50)
    assert len(x) == len(y) == 50
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 4 == 2 else q) for i, q in labels]
    a, b = (re_.fit(d, spark.createDataFrame(k, "doc_id long, quality int"), trees=5) for k in (labels, flipped))
    assert a == b


def test_lasso_leaves_few_rules():
    rng = np.random.default_rng(0)
    x = rng.random((800, len(re_.STATISTICS)))
    y = ((x[:, 0] > 0.5) & (x[:, 3] < 0.7)).astype(float)
    model = re_.fit_rules(x, y, trees=20)
    assert ((model.score(x) >= 0.5) == y).mean() > 0.97
    assert len(model.rules) < len(re_.extract_rules(x, y, trees=20)) / 2


def test_labels_of_one_kind_and_none(spark):
    assert re_.fit_rules(np.zeros((9, 24)), np.ones(9)).score(np.zeros((1, 24)))[0] == pytest.approx(10 / 11)
    none, lab = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, quality int")
    assert re_.classify(none, lab).count() == 0


def plain(text):
    """The statistics by their names, one loop each."""
    raw = text.encode()
    words = [w for w in re_words(text)]
    if not words:
        return dict.fromkeys(re_.STATISTICS, 0.0)
    n, lens = len(words), [len(w) for w in words]
    chars = sum(lens)
    inside = [b for w in words for b in w]
    of = lambda test: sum(map(test, inside)) / chars
    upper, lower, digit = lambda b: 65 <= b <= 90, lambda b: 97 <= b <= 122, lambda b: 48 <= b <= 57
    mark = lambda b: 33 <= b <= 126 and not (upper(b) or lower(b) or digit(b))
    count = Counter(words)
    most = sorted(count.values(), reverse=True)
    windows = Counter(tuple(words[i : i + 3]) for i in range(n - 2))
    repeated = {i + k for i in range(n - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re_words(x)]
    letter = lambda b: upper(b) or lower(b) or b >= 128
    # control bytes inside words are neither letter, digit nor mark: "high" holds them too
    return {
        "log_words": math.log(1 + n), "mean_word": chars / n, "sd_word": statistics.pstdev(lens), "longest_word": max(lens),
        "upper_share": of(upper), "lower_share": of(lower), "digit_share": of(digit), "mark_share": of(mark),
        "symbol_share": of(lambda b: chr(b) in "#*$%&|<>{}[]\\^~_=+@"), "high_share": of(lambda b: not (upper(b) or lower(b) or digit(b) or mark(b))),
        "pipe_share": raw.count(b"|") / n, "bang_share": raw.count(b"!") / n,
        "marked_words": sum(not (letter(w[-1]) or w[-1] in b".,") for w in words) / n, "short_words": sum(k <= 2 for k in lens) / n,
        "distinct_share": len(count) / n, "top_share": most[0] / n, "top5_share": sum(most[:5]) / n, "repeat_share": len(repeated) / n,
        "stutter_share": sum(a == b for a, b in zip(words, words[1:])) / n, "dup_line_share": sum(x in lines[:i] for i, x in enumerate(lines)) / len(lines),
        "log_lines": math.log(1 + len(lines)), "mean_line": n / len(lines), "stop_share": sum(w[-1] == 46 for w in words) / n,
        "capital_words": sum(upper(w[0]) for w in words) / n,
    }


def re_words(text):
    out, word = [], []
    for c in text + " ":
        if c in " \t\n\v\f\r":
            if word:
                out.append("".join(word).encode())
            word = []
        else:
            word.append(c)
    return out


@pytest.mark.parametrize("seed", range(40))
def test_statistics_equal_their_definitions(seed):
    rng = random.Random(seed)
    pool = ["a", "The", "the", "of.", "naïve", "x1", "###", "|", "end!", "\u00a0", "ÄB", "日本。", "a\x1cb", "{k}=1", "Stop."][: rng.randint(2, 15)]
    text = "".join(rng.choice(pool) + rng.choice([" ", " ", "\t", "\n", "  ", "\r\n", "\n\n"]) for _ in range(rng.choice([0, 1, 3, 4, 60, 400])))
    got = dict(zip(re_.STATISTICS, re_.statistics(text), strict=True))
    for name, value in plain(text).items():
        assert got[name] == pytest.approx(value, abs=1e-12), name
