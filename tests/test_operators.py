import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import aggregates, merge, reads, transactions

SCHEMA = "key string, commit_ts long, seq long, value string, is_deleted boolean"


@pytest.fixture(scope="module")
def chain(spark):
    """Version chains of six keys."""
    rows = [("key1", 1), ("key1", 2), ("key1", 3), ("key2", 1), ("key2", 2), ("key3", 1), ("key3", 2), ("key4", 1), ("key5", 1), ("key6", 1), ("key6", 2)]
    return spark.createDataFrame([(k, t, i, f"{k}@{t}", (k, t) == ("key2", 2)) for i, (k, t) in enumerate(rows)], SCHEMA)


def values(d):
    return sorted(r["value"] for r in d.collect())


def test_point_reads_as_of(chain):
    assert values(reads.get(chain, "key1", 4)) == ["key1@3"]
    assert values(reads.get(chain, "key1", 2)) == ["key1@2"]
    assert values(reads.get(chain, "key2", 1)) == ["key2@1"]
    assert values(reads.get(chain, "key2", 2)) == []
    assert reads.newest(chain, 2).filter("key = 'key2'").first()["is_deleted"]
    assert values(reads.get(chain, "key3", 0)) == [] and values(reads.get(chain, "keyX", 9)) == []
    assert values(reads.get(chain, "key6", 42)) == ["key6@2"]


def test_tombstones_do_not_resurrect(chain):
    assert "key2@1" not in values(reads.snapshot(chain)) and "key2@1" in values(reads.snapshot(chain, 1))


def test_ranges(chain):
    assert values(reads.range_scan(chain, "key1", "key3")) == ["key1@3", "key3@2"]
    assert values(reads.range_scan(chain, "key3", "key1")) == []
    assert "Filter" not in reads.key_range(chain, "z", "a")._jdf.queryExecution().optimizedPlan().toString()
    assert len(values(reads.range_versions(chain, "key2", "key2"))) == 2
    assert values(reads.range_versions(chain, "key2", "key2", deleted=False)) == ["key2@1"]


def test_first_last_and_order(chain):
    row = reads.first_and_last(chain).first()
    assert (row["first"]["value"], row["last"]["value"]) == ("key1@1", "key6@2")
    assert [r["value"] for r in reads.ordered(chain).collect()][:4] == ["key1@1", "key1@2", "key1@3", "key2@1"]


def brute_asof(rows, key, ts):
    own = [r for r in rows if r[0] == key and r[1] <= ts]
    best = max(own, key=lambda r: (r[1], r[2]), default=None)
    return None if best is None or best[4] else best[3]


@pytest.mark.parametrize("buckets", [1, 5, 64])
def test_multi_get_equals_brute_force(spark, buckets):
    rng = random.Random(buckets)
    rows = [(rng.choice(["hot"] * 3 + ["a", "b", "c"]), rng.randrange(500), i, f"v{i}", rng.random() < 0.2) for i in range(400)]
    probes = [(rng.choice(["hot", "a", "b", "none"]), rng.randrange(-10, 520), i) for i in range(200)]
    v = spark.createDataFrame(rows, SCHEMA)
    p = spark.createDataFrame(probes, "key string, probe_ts long, id long")
    want = sorted((i, k, x) for k, t, i in probes if (x := brute_asof(rows, k, t)) is not None)
    assert sorted((r["id"], r["key"], r["value"]) for r in reads.multi_get(v, p, buckets=buckets, one_task=0).collect()) == want
    assert sorted((r["id"], r["key"], r["value"]) for r in reads.multi_get_by_join(v, p).collect()) == want


def test_multi_get_of_nothing(spark, chain):
    none = spark.createDataFrame([], "key string, probe_ts long, id long")
    assert reads.multi_get(chain, none).count() == 0
    assert reads.multi_get(chain.limit(0), none).count() == 0


@pytest.mark.parametrize("buckets", [1, 7])
def test_history(spark, buckets):
    rng = random.Random(3)
    times = {(rng.choice("ab"), rng.randrange(1000)) for _ in range(200)}
    rows = [(k, t, i, "v", False) for i, (k, t) in enumerate(sorted(times))]
    got = {(r["key"], r["commit_ts"]): r["valid_to"] for r in reads.history(spark.createDataFrame(rows, SCHEMA), buckets).collect()}
    for k, t in times:
        assert got[k, t] == min((u for j, u in times if j == k and u > t), default=None)


def test_last_writer_wins(spark):
    rows = [("1", 0, 1, "foo", False), ("1", 0, 2, "bar", False), ("2", 0, 1, "x", False)]
    d = spark.createDataFrame(rows, SCHEMA)
    assert values(merge.merge_runs([d.filter("seq = 1"), d.filter("seq = 2")])) == ["bar", "x"]


def test_compaction_groups():
    runs = [{"level": 0, "seq": s} for s in (5, 1, 2, 9)] + [{"level": 1, "seq": s} for s in (3, 4, 6)] + [{"level": 2, "seq": s} for s in (7, 8, 10)]
    groups = [[r["seq"] for r in g] for g in merge.compaction_groups(runs)]
    assert groups == [[1, 2, 5], [3, 4, 6]]
    assert merge.compaction_groups(runs[:2]) == []


def test_garbage_collection_changes_no_later_read(spark, chain):
    kept = merge.collect_garbage(chain, 2)
    for t in (2, 3, 9):
        assert values(reads.snapshot(kept, t)) == values(reads.snapshot(chain, t))
    assert kept.count() < chain.count()
    assert merge.collect_garbage(chain, 2, drop_tombstones=True).filter("is_deleted").count() == 0


@pytest.mark.parametrize("fan_out", [3, 10, 4096])
def test_running_total(spark, fan_out):
    rng = random.Random(1)
    rows = [(i * 3 - 40, rng.randrange(50)) for i in range(100)]
    got = dict(merge.running_total(spark.createDataFrame(rows, "o long, x long"), "o", "x", "t", fan_out).select("o", "t").collect())
    total = 0
    for o, x in rows:
        total += x
        assert got[o] == total
    assert merge.running_total(spark.createDataFrame([], "o long, x long"), "o", "x", "t").count() == 0


def test_statistics(spark, chain):
    runs = aggregates.run_statistics(chain.withColumn("run", F.lit(1)))
    row = runs.first()
    assert (row["n_keys"], row["min_key"], row["max_key"]) == (11, "key1", "key6")
    assert aggregates.totals(runs.limit(0)).first()["total_bytes"] == 0
    assert aggregates.approximate_keys(chain).first()[0] == 6
    assert reads.prune_runs(runs, "key9").count() == 0 and reads.prune_runs(runs, "key3").count() == 1 and reads.prune_runs(runs, "z", "a").count() == 0


def test_overlay_and_conflicts(spark):
    base = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "key string, value string")
    w = spark.createDataFrame([("b", "new", False), ("c", None, True), ("d", "4", False)], "key string, value string, is_deleted boolean")
    assert sorted(map(tuple, transactions.overlay(base, w).collect())) == [("a", "1"), ("b", "new"), ("d", "4")]
    writes = spark.createDataFrame([(1, "a", 10), (2, "b", 10), (3, "c", 10)], "txn int, key string, start_ts long")
    log = spark.createDataFrame([("a", 11), ("a", 12), ("b", 10), ("z", 99)], "key string, log_ts long")
    assert [r["txn"] for r in transactions.conflicts(writes, log).collect()] == [1]
    assert transactions.conflicts(writes.withColumn("commit_ts", F.lit(10)), log).count() == 0


def test_places_in_the_total_order(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.choice(["hot"] * 3 + ["a", "z"]), rng.randrange(50), i, f"v{i}", False) for i in range(500)]
    got = reads.ordered_places(spark.createDataFrame(rows, SCHEMA).repartition(7), f"file://{tmp_path}/places").collect()
    want = {r[2]: k + 1 for k, r in enumerate(sorted(rows, key=lambda r: r[:3]))}
    assert {r["seq"]: r["place"] for r in got} == want
    assert reads.ordered_places(spark.createDataFrame([], SCHEMA), f"file://{tmp_path}/none").count() == 0


def test_work_folders_are_released(spark):
    from palimpsest.sources.files import Files, fresh_folder, release

    path = fresh_folder(spark, "x")
    spark.range(3).write.parquet(path)
    assert release(spark) >= 1 and not Files(spark, path).exists("") and release(spark) == 0
