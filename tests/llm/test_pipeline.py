"""The pipeline and the registered queries over small tables."""

import random

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from palimpsest.llm import simhash
from palimpsest.llm._shared import BATCH_BYTES, held, materialize, ship
from palimpsest.llm._shared import _bytes as size_in_bytes


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(11)
    folder = tmp_path_factory.mktemp("tables")
    vocabulary = [f"{a}{b}" for a in "the river stone light house water old new".split() for b in ("", "s", "ing", "ed", "ly", "er")]
    docs, labels, pages = [], [], []
    for i in range(240):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(60, 160))]
        good = i % 6 != 0
        if not good:
            words = [w + "###" for w in words]
        if i % 20 == 1:
            words[30:30] = ["token", "=", '"%040x"' % rng.getrandbits(160)]
        docs.append((i, " ".join(words), "en", f"src{i % 4}", 0))
        labels.append((i, int(good), 0))
        pages.append((i, f"http://h{i % 7}.example.net/{'en' if i % 2 else 'de'}/{i}", f"<p>{i % 50}</p>"))
    for i in range(1, 240, 40):  # exact copies
        docs.append((1000 + i, docs[i][1], "en", "src0", 0))
    docs += [(2000, None, None, None, None), (2001, "", "en", "src1", 0), (None, docs[5][1], "en", "src1", 0)]
    docs = [(*d[:4], len(d[1] or "")) for d in docs]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"file://{folder}/labels.parquet")
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"file://{folder}/pages.parquet")
    return str(folder), docs, dict((i, q) for i, q, _ in labels)


def test_stages(spark, tables):
    folder, rows, good = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, [docs]
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality classifier", "SimHash near-dedup", "secret scans", "mixing sources to target weights", "SentencePiece encoding and decoding"]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = materialize(stage(spark, docs.withColumn("score", docs["doc_id"]) if k == 0 else docs, folder).drop("score"), "stage")
        if k < 4:
            assert docs.columns == columns
        seen.append(docs)
    accepted, single, masked, mixed, encoded = (d.collect() for d in seen[1:])
    ids = {r["doc_id"] for r in accepted}
    assert not any(good.get(i) == 0 for i in ids) and sum(good[i] for i in ids if i in good) >= 0.97 * sum(good.values())
    # one row of each component of what came in
    want = {r["component_id"] for r in simhash.components(seen[1]).collect()}
    assert sorted(r["doc_id"] for r in single) == sorted(want) and len(single) < len(accepted)
    assert {r["doc_id"] for r in masked} == {r["doc_id"] for r in single}
    before = {r["doc_id"]: r["text"] or "" for r in single}
    for r in masked:
        if "token" in before[r["doc_id"]]:
            assert "[SECRET]" in r["text"] and "token =" not in r["text"]
        assert r["text"] is None or r["n_chars"] == len(r["text"])
    assert sum((r["text"] or "") != before[r["doc_id"]] for r in masked if "token" not in before[r["doc_id"]]) == 0
    assert len(encoded) == len(mixed) and all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in encoded)
    from palimpsest.llm.mixing import mix

    assert sum(r["copies"] for r in mix(seen[3]).collect()) == len(mixed)
    again = corpus_pipeline.run(spark, folder)
    assert sorted(map(str, again.collect())) == sorted(map(str, encoded))


def test_empty_tables(spark, tables, tmp_path):
    for name in ("documents", "labels", "pages"):
        spark.read.parquet(f"{tables[0]}/{name}.parquet").limit(0).write.parquet(f"file://{tmp_path}/{name}.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.collect() == [] and out.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "round_trip"]


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if n.startswith("op")))
def test_queries_return_a_row_a_record(spark, tables, name):
    folder, rows, _ = tables
    out = entry.queries()[name](spark, folder).collect()
    pages = name in ("op1_warc", "op7_url_filters")
    assert len(out) == (240 if pages else len(rows))


def test_entry_names_them_all():
    found = [n for n in entry.queries() if n.startswith("op") or n == "pipeline"]
    assert len(found) == 11 and "pipeline" in found


def test_one_model_a_worker():
    made = []
    load = lambda name: lambda: made.append(name) or name
    assert [held(k, load(k)) for k in "aabba"] == list("aabba") and made == ["a", "b", "a"]
    assert held("none") is None and held("a", load("a")) == "a" and made == ["a", "b", "a", "a"]


def test_batches_are_bounded_by_bytes(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    for before, after in (("64MB", BATCH_BYTES), ("1m", 1 << 20)):
        spark.conf.set(name, before)
        ship(spark)
        assert size_in_bytes(spark.conf.get(name)) == after
    spark.conf.unset(name)
