import base64
import hashlib
import random

import pytest

from palimpsest.llm import warc

SCHEMA = "page_id long, url string, html string"


def brute(rows, least=0):
    """Sorted (page_id, payload_bytes, digest, type, refers_to)."""
    most = {}
    for i, _, h in rows:
        h = h or ""
        if i is not None:
            most[h] = max(i, most.get(h, i))
    out = []
    for i, _, h in rows:
        h = h or ""
        raw = h.encode()
        revisit = i != most.get(h) and len(raw) >= least
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", most.get(h) if revisit else None))
    return sorted(map(str, out))


def got(d):
    return sorted(str((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])) for r in d.collect())


@pytest.mark.parametrize("key,want", [
    (None, ""), ("", ""), ("http://Blog.Example.com/x?y#z", "com,example,blog)/x?y#z"), ("https://a.b", "b,a)"), ("no scheme", ")no%20scheme"), ("http://a.b/c\td\n", "b,a)/c%09d%0A"), ("http://a.b?q", "b,a)?q"),
])
def test_keys(key, want):
    assert warc.url_key(key) == want


def test_records():
    payload = "hé\r\n\r\nllo".encode()
    digest = warc.payload_digest(payload)
    headers, back = warc.parse_record(warc.build_record(7, "http://a/\r\nX: y", payload, digest, None, False))
    assert back == payload and headers["warc-type"] == "response" and headers["x-page-id"] == "7" and headers["warc-target-uri"] == "http://a/%0D%0AX:%20y"
    headers, back = warc.parse_record(warc.build_record(7, None, payload, digest, 9, True))
    assert back == b"" and headers["warc-type"] == "revisit" and headers["warc-refers-to"] == warc.record_id(9, digest) and "warc-target-uri" not in headers


def pages(seed, n=120):
    rng = random.Random(seed)
    rows = [(i, f"http://h{rng.randrange(6)}.test/p{rng.randrange(9)}", "same page" if i % 3 == 0 else "".join(rng.choice("abé<>\r\n ") for _ in range(rng.randrange(400)))) for i in range(n)]
    return rows + [(500, None, None), (501, "", ""), (502, "http://h1.test/p1", None), (None, "http://x.test/", "same page"), (None, "http://x.test/", "only without id"), (7, "http://again.test/", "x" * 300_000), (7, "http://again.test/", "x" * 300_000)]


@pytest.mark.parametrize("lines,least", [(4, 0), (256, 0), (3, 20)])
def test_round_trip(spark, lines, least):
    rows = pages(lines)
    d = spark.createDataFrame(rows, SCHEMA).repartition(3).selectExpr("*", "'q' AS payload", "1 AS url_key")
    assert got(warc.round_trip(d, block_lines=lines, min_revisit_bytes=least, file_bytes=4000)) == brute(rows, least)


def test_lookups_equal_a_scan(spark):
    rows = pages(1)
    d = spark.createDataFrame(rows, SCHEMA).repartition(3)
    archive = warc.write(d, block_lines=3)
    keys = sorted({warc.url_key(u) for _, u, _ in rows})
    for key in [*keys, "", "a", "zzz", "test,h1)/p1x"]:
        found = archive.index.lookup(key, any_id=True)
        assert sorted(str(None if x[1] == warc.NO_ID else x[1]) for x in found) == sorted(str(i) for i, u, _ in rows if warc.url_key(u) == key)
        assert found == sorted(found)
    i, u, h = rows[1]
    captures = archive.lookup(spark.createDataFrame([(warc.url_key(u), i), ("test,none)", 1)], "url_key string, page_id long"))
    (record,) = archive.read(captures).collect()
    assert (record["page_id"], record["url"]) == (i, u) and bytes(record["payload"]).decode() == h


def test_no_pages(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_equals_its_sql(spark, tmp_path):
    import duckdb

    from palimpsest.llm.queries import ORACLE, op1_warc

    spark.createDataFrame([r for r in pages(2) if r[0] is not None], SCHEMA).dropDuplicates(["page_id"]).coalesce(1).write.parquet(f"file://{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert got(op1_warc(spark, str(tmp_path))) == sorted(map(str, con.execute(ORACLE["op1_warc"]).fetchall()))
