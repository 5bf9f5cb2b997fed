"""Queries for each operator over the driver's tables, with DuckDB SQL of the
same meaning.

``events`` is the table of versions: key user_id, commit_ts the microseconds of
ts, seq event_id, value event_type, and errors are tombstones. Timestamps are cast
to the session's zone, which has to be UTC. A run is a thousand events in order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import codec
from palimpsest.model import ConflictError, StoreConfig
from palimpsest.operators import aggregates, filters, merge, reads, transactions
from palimpsest.sources import binary
from palimpsest.sources.files import Files, fresh_folder

#: 2024-01-16, in the middle of the events.
S = 1705363200000000
RUN = 1000

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

V = """v AS (SELECT user_id AS key, epoch_us(ts) AS commit_ts, event_id AS seq, event_type AS value, event_type = 'error' AS is_deleted FROM events)"""
#: newest version of each key, tombstones included
NEWEST = "SELECT key, arg_max({'commit_ts': commit_ts, 'seq': seq, 'value': value, 'is_deleted': is_deleted}, {'commit_ts': commit_ts, 'seq': seq}) AS x FROM v"


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("commit_ts"), F.col("event_id").alias("seq"),
        F.col("event_type").alias("value"), (F.col("event_type") == "error").alias("is_deleted"),
    )


def _shown(d: DataFrame) -> DataFrame:
    return d.select("key", "commit_ts", "seq", "value")


LIVE = "SELECT key, x.commit_ts AS commit_ts, x.seq AS seq, x.value AS value FROM (%s) WHERE NOT x.is_deleted"


@query("latest_live", f"WITH {V} " + LIVE % f"{NEWEST} GROUP BY key")
def latest_live(spark, sf_dir):
    return _shown(reads.snapshot(versions(spark, sf_dir)))


@query("snapshot_asof", f"WITH {V} " + LIVE % f"{NEWEST} WHERE commit_ts <= {S} GROUP BY key")
def snapshot_asof(spark, sf_dir):
    return _shown(reads.snapshot(versions(spark, sf_dir), S))


@query("range_snapshot", f"WITH {V} " + LIVE % f"{NEWEST} WHERE key BETWEEN 10 AND 20 AND commit_ts <= {S} GROUP BY key")
def range_snapshot(spark, sf_dir):
    return _shown(reads.range_scan(versions(spark, sf_dir), 10, 20, S))


@query("range_bytes", f"WITH {V} SELECT hex(key) AS key_hex, x.value AS value FROM (SELECT encode(CAST(key AS VARCHAR)) AS key, x FROM ({NEWEST} GROUP BY key)) WHERE key BETWEEN encode('10') AND encode('20') AND NOT x.is_deleted")
def range_bytes(spark, sf_dir):
    v = versions(spark, sf_dir).withColumn("key", codec.str_key(F.col("key").cast("string")))
    return reads.range_scan(v, bytearray(b"10"), bytearray(b"20")).select(F.hex("key").alias("key_hex"), "value")


RANGES = ((20, 10), (10, 20), (-5, -1), (15, 15), (140, 10_000))


@query("range_counts", f"WITH {V}, live AS ({LIVE % f'{NEWEST} GROUP BY key'}), r(low, high) AS (VALUES {', '.join(f'({a}::BIGINT, {b}::BIGINT)' for a, b in RANGES)}) SELECT low, high, (SELECT count(*) FROM live WHERE key BETWEEN low AND high) AS n FROM r")
def range_counts(spark, sf_dir):
    """Live keys of inclusive ranges; inverted ones and those past the ends have none."""
    v, out = versions(spark, sf_dir), None
    for low, high in RANGES:
        n = reads.range_scan(v, low, high).agg(F.count(F.lit(1)).alias("n")).select(F.lit(low).cast("long").alias("low"), F.lit(high).cast("long").alias("high"), "n")
        out = n if out is None else out.unionByName(n)
    return out


@query("range_versions", f"WITH {V} SELECT key, commit_ts, seq, value, is_deleted FROM v WHERE key BETWEEN 10 AND 20")
def range_versions(spark, sf_dir):
    return reads.range_versions(versions(spark, sf_dir), 10, 20)


def _point(key: int) -> str:
    return f"WITH {V} " + LIVE % f"{NEWEST} WHERE key = {key} GROUP BY key"


@query("point_get", _point(2))
def point_get(spark, sf_dir):
    return _shown(reads.get(versions(spark, sf_dir), 2))


@query("point_get_missing", _point(-1))
def point_get_missing(spark, sf_dir):
    return _shown(reads.get(versions(spark, sf_dir), -1))


@query("point_get_deleted", f"WITH {V}, n AS ({NEWEST} GROUP BY key) SELECT c_custkey AS key, coalesce(NOT x.is_deleted, false) AS found, coalesce(x.is_deleted, false) AS deleted FROM customer LEFT JOIN n ON n.key = c_custkey WHERE c_custkey <= 200")
def point_get_deleted(spark, sf_dir):
    """For each key asked for, whether a read finds it and whether a tombstone is why it does not."""
    v = versions(spark, sf_dir)
    asked = table(spark, sf_dir, "customer").filter("c_custkey <= 200").select(F.col("c_custkey").alias("key"))
    found = reads.get_many(v, asked).select("key", F.lit(True).alias("found"))
    gone = reads.only_keys(reads.newest(v).filter("is_deleted"), asked).select("key", F.lit(True).alias("deleted"))
    out = asked.join(found, "key", "left").join(gone, "key", "left")
    return out.select("key", F.coalesce("found", F.lit(False)).alias("found"), F.coalesce("deleted", F.lit(False)).alias("deleted"))


PROBES = "p AS (SELECT (event_id * 7) % 150 AS key, epoch_us(ts) + 1800000000 AS probe_ts, event_id AS probe FROM events WHERE event_id % 10 = 0)"


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter("event_id % 10 = 0")
    return e.select(((F.col("event_id") * 7) % 150).alias("key"), (F.unix_micros(F.col("ts").cast("timestamp")) + 1800000000).alias("probe_ts"), F.col("event_id").alias("probe"))


ASOF = f"WITH {V}, {PROBES} SELECT p.key AS key, p.probe AS probe, p.probe_ts AS probe_ts, v.commit_ts AS commit_ts, v.value AS value FROM p ASOF JOIN v ON p.key = v.key AND p.probe_ts >= v.commit_ts WHERE NOT v.is_deleted"


@query("multi_get_asof", ASOF)
def multi_get_asof(spark, sf_dir):
    return reads.multi_get(versions(spark, sf_dir), probes(spark, sf_dir)).select("key", "probe", "probe_ts", "commit_ts", "value")


@query("multi_get_asof_join", ASOF)
def multi_get_asof_join(spark, sf_dir):
    return reads.multi_get_by_join(versions(spark, sf_dir), probes(spark, sf_dir)).select("key", "probe", "probe_ts", "commit_ts", "value")


@query("get_many", f"WITH {V} " + LIVE % f"{NEWEST} WHERE commit_ts <= {S} AND key IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY key")
def get_many(spark, sf_dir):
    """Many keys at one time."""
    keys = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("key"))
    return _shown(reads.get_many(versions(spark, sf_dir), keys, S))


@query("version_count", f"WITH {V} SELECT key, count(*) AS n_versions, count(*) FILTER (is_deleted) AS n_tombstones FROM v GROUP BY key")
def version_count(spark, sf_dir):
    return aggregates.version_counts(versions(spark, sf_dir))


@query("history_validity", f"WITH {V} SELECT key, commit_ts, seq, value, lead(commit_ts) OVER (PARTITION BY key ORDER BY commit_ts, seq) AS valid_to FROM v")
def history_validity(spark, sf_dir):
    return reads.history(versions(spark, sf_dir)).select("key", "commit_ts", "seq", "value", "valid_to")


@query("encode_key", "SELECT event_id, hex(encode(CAST(user_id AS VARCHAR))) || printf('%016X', epoch_us(ts)) AS encoded FROM events")
def encode_key(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    encoded = codec.encode_key(codec.str_key(F.col("user_id").cast("string")), F.unix_micros(F.col("ts").cast("timestamp")))
    return e.select("event_id", F.hex(encoded).alias("encoded"))


@query("decode_key", "SELECT event_id, CAST(user_id AS VARCHAR) AS key, epoch_us(ts) AS commit_ts FROM events")
def decode_key(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    encoded = codec.encode_key(codec.str_key(F.col("user_id").cast("string")), F.unix_micros(F.col("ts").cast("timestamp")))
    e = e.select("event_id", encoded.alias("encoded"))
    return e.select("event_id", F.decode(codec.decoded_key(F.col("encoded")), "UTF-8").alias("key"), codec.decoded_ts(F.col("encoded")).alias("commit_ts"))


@query("int_key_order", "SELECT DISTINCT user_id AS key, printf('%016X', user_id) AS int_key FROM events")
def int_key_order(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("key")).distinct()
    return e.select("key", F.hex(codec.int_key(F.col("key"))).alias("int_key"))


OVERLAP = """two AS (SELECT key, commit_ts // 86400000000 AS commit_ts, seq, value, is_deleted FROM v WHERE seq % 3 <> 0
UNION ALL SELECT key, commit_ts // 86400000000, seq, value, is_deleted FROM v WHERE seq % 3 <> 1)"""


@query("lww_dedup", f"WITH {V}, {OVERLAP} SELECT key, commit_ts, seq, value, is_deleted FROM two QUALIFY row_number() OVER (PARTITION BY key, commit_ts ORDER BY seq DESC) = 1")
def lww_dedup(spark, sf_dir):
    """Two overlapping runs with many versions a (key, day)."""
    v = versions(spark, sf_dir).withColumn("commit_ts", F.floor(F.col("commit_ts") / 86400000000).cast("long"))
    return merge.merge_runs([v.filter("seq % 3 <> 0"), v.filter("seq % 3 <> 1")])


SIZES = "octet_length(encode(CAST(user_id AS VARCHAR))) + 8 + CASE WHEN event_type = 'error' THEN 1 ELSE octet_length(encode(event_type)) END"
RUNS = f"r AS (SELECT event_id // {RUN} AS run, user_id AS key, CAST({SIZES} AS BIGINT) AS bytes FROM events)"


def in_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = versions(spark, sf_dir)
    value = F.when(~F.col("is_deleted"), codec.str_key(F.col("value")))
    return v.withColumn("run", F.floor(F.col("seq") / RUN).cast("long")).withColumn("user", F.col("key")).withColumn("key", codec.str_key(F.col("key").cast("string"))).withColumn("value", value)


@query("run_stats", f"WITH {RUNS} SELECT run, count(*) AS n_keys, CAST(sum(bytes) AS BIGINT) AS bytes, hex(min(encode(CAST(key AS VARCHAR)))) AS min_key, hex(max(encode(CAST(key AS VARCHAR)))) AS max_key FROM r GROUP BY run")
def run_stats(spark, sf_dir):
    out = aggregates.run_statistics(in_runs(spark, sf_dir))
    return out.withColumn("min_key", F.hex("min_key")).withColumn("max_key", F.hex("max_key"))


@query("compact_runs", f"WITH {RUNS}, n AS (SELECT max(run) + 1 AS runs FROM r), g AS (SELECT run // 3 AS grp, key, bytes FROM r) SELECT grp, count(*) AS n_keys, CAST(sum(bytes) AS BIGINT) AS bytes, min(key) AS min_key, max(key) AS max_key, (grp + 1) * 3 <= (SELECT runs FROM n) AS promoted FROM g GROUP BY grp")
def compact_runs(spark, sf_dir):
    """Groups of three runs of level 0, oldest first; only full ones go up a level."""
    v = in_runs(spark, sf_dir).withColumn("grp", merge.group_of_run(F.col("run")))
    sums = v.groupBy("grp").agg(
        F.count(F.lit(1)).alias("n_keys"), F.sum(merge.version_bytes(F.col("key"), F.col("value"))).alias("bytes"),
        F.min("user").alias("min_key"), F.max("user").alias("max_key"), F.max("run").alias("last"),
    )
    # the number of runs is one number
    runs = (sums.agg(F.max("last")).first()[0] or 0) + 1
    return sums.select("grp", "n_keys", "bytes", "min_key", "max_key", ((F.col("grp") + 1) * 3 <= F.lit(runs)).alias("promoted"))


@query("compact_equiv", ORACLE["latest_live"])
def compact_equiv(spark, sf_dir):
    """The newest live values over runs merged in groups of three."""
    v = versions(spark, sf_dir).withColumn("grp", merge.group_of_run(F.floor(F.col("seq") / RUN)))
    merged = v.groupBy("grp", "key", "commit_ts").agg(F.max_by(F.struct("seq", "value", "is_deleted"), F.col("seq")).alias("x"))
    return _shown(reads.snapshot(merged.select("key", "commit_ts", "x.*")))


@query("gc_compact", f"WITH {V} SELECT key, commit_ts, seq, value, is_deleted FROM v WHERE commit_ts > {S} UNION ALL SELECT key, commit_ts, seq, value, is_deleted FROM (SELECT * FROM v WHERE commit_ts <= {S} QUALIFY row_number() OVER (PARTITION BY key ORDER BY commit_ts DESC, seq DESC) = 1)")
def gc_compact(spark, sf_dir):
    return merge.collect_garbage(versions(spark, sf_dir), S)


BUDGET = 4096


@query("flush_plan", f"WITH s AS (SELECT event_id AS seq, CAST({SIZES} AS BIGINT) AS bytes FROM events) SELECT seq, bytes, CAST((sum(bytes) OVER (ORDER BY seq ROWS UNBOUNDED PRECEDING) - bytes) // {BUDGET} AS BIGINT) AS run FROM s")
def flush_plan(spark, sf_dir):
    rows = in_runs(spark, sf_dir).select("seq", merge.version_bytes(F.col("key"), F.col("value")).alias("bytes"))
    return merge.plan_flushes(rows, "seq", "bytes", BUDGET)


@query("metrics", f"WITH {RUNS} SELECT count(DISTINCT run) AS n_runs, count(*) AS total_versions, CAST(sum(bytes) AS BIGINT) AS total_bytes FROM r")
def metrics(spark, sf_dir):
    return aggregates.totals(aggregates.run_statistics(in_runs(spark, sf_dir)))


SORTED_RUNS = "k AS (SELECT key // 16 AS run, min(key) AS min_key, max(key) AS max_key, count(*) AS n_keys FROM v GROUP BY run)"


@query("prune_minmax", f"WITH {V}, {SORTED_RUNS} SELECT run, min_key, max_key, n_keys FROM k WHERE min_key <= 40 AND max_key >= 30")
def prune_minmax(spark, sf_dir):
    """Of runs sorted by key, those that can hold keys 30 to 40."""
    v = versions(spark, sf_dir).withColumn("run", F.floor(F.col("key") / 16).cast("long"))
    runs = v.groupBy("run").agg(F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.count(F.lit(1)).alias("n_keys"))
    return reads.prune_runs(runs, 30, 40)


@query("bloom_semi", f"WITH {V} SELECT key, commit_ts, seq, value, is_deleted FROM v WHERE key IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def bloom_semi(spark, sf_dir):
    keys = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("key"))
    return filters.bloom_semi(versions(spark, sf_dir), keys).select("key", "commit_ts", "seq", "value", "is_deleted")


@query("bloom_members", f"WITH {V}, k AS (SELECT DISTINCT key FROM v WHERE key % 2 = 0) SELECT (SELECT count(*) FROM k) AS members, 0::BIGINT AS missed, true AS few_wrong")
def bloom_members(spark, sf_dir):
    """A filter over even keys, asked for a thousand times as many numbers: no
    member is missed, and under 2% of the others pass."""
    keys = versions(spark, sf_dir).filter("key % 2 = 0").select("key").distinct()
    asked = spark.range(200_000).select(F.col("id").alias("key"))
    blocks = filters.blocks_for(keys.count())
    passed = filters.might_contain(asked.unionByName(keys.filter("key >= 200000")), filters.bloom_blocks(keys, blocks), blocks)
    got = keys.select("key", F.lit(1).alias("member")).join(passed.select("key", F.lit(1).alias("passed")), "key", "full")
    return got.agg(
        F.sum(F.coalesce("member", F.lit(0))).cast("long").alias("members"), F.count_if(F.col("member").isNotNull() & F.col("passed").isNull()).alias("missed"),
        (F.count_if(F.col("member").isNull()) < 0.02 * 200_000).alias("few_wrong"),
    )


WRITES = "w AS (SELECT c_custkey AS key, c_name AS value, c_custkey % 5 = 0 AS is_deleted FROM customer WHERE c_custkey % 3 = 0 AND c_custkey <= 300)"


@query("txn_overlay", f"WITH {V}, {WRITES}, base AS ({LIVE % f'{NEWEST} GROUP BY key'}) SELECT key, value FROM base WHERE key NOT IN (SELECT key FROM w) UNION ALL SELECT key, value FROM w WHERE NOT is_deleted")
def txn_overlay(spark, sf_dir):
    w = table(spark, sf_dir, "customer").filter("c_custkey % 3 = 0 AND c_custkey <= 300").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("value"), (F.col("c_custkey") % 5 == 0).alias("is_deleted"))
    return transactions.overlay(reads.snapshot(versions(spark, sf_dir)), w)


TXNS = """t AS (SELECT o_orderkey AS txn, l_partkey AS key, epoch_us(o_orderdate) AS start_ts, epoch_us(o_orderdate) + 86400000000 AS commit_ts FROM orders JOIN lineitem ON l_orderkey = o_orderkey)"""


def txns(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, item = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    start = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    return o.join(item, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_orderkey").alias("txn"), F.col("l_partkey").alias("key"), start.alias("start_ts"), (start + 86400000000).alias("commit_ts"))


@query("txn_conflicts", f"WITH {TXNS} SELECT DISTINCT a.txn AS txn, a.key AS key FROM t a WHERE a.txn % 10 = 0 AND EXISTS (SELECT 1 FROM t c WHERE c.txn % 10 <> 0 AND c.key = a.key AND c.commit_ts > a.start_ts AND c.commit_ts <= a.commit_ts)")
def txn_conflicts(spark, sf_dir):
    """Writes of open transactions (every tenth order) that an earlier committer conflicts with."""
    t = txns(spark, sf_dir)
    log = t.filter("txn % 10 <> 0").select("key", F.col("commit_ts").alias("log_ts"))
    return transactions.conflicts(t.filter("txn % 10 = 0"), log).select("txn", "key").distinct()


@query("txn_readonly_ok", f"WITH {TXNS}, o AS (SELECT o_orderkey AS txn, o_orderpriority = '1-URGENT' AS writes FROM orders WHERE o_orderkey % 10 = 0) SELECT txn, writes, NOT (writes AND EXISTS (SELECT 1 FROM t a JOIN t c ON c.key = a.key WHERE a.txn = o.txn AND c.txn % 10 <> 0 AND c.commit_ts > a.start_ts AND c.commit_ts <= a.commit_ts)) AS ok FROM o")
def txn_readonly_ok(spark, sf_dir):
    """Of every tenth order the urgent ones write and the others only read: which may commit."""
    t = txns(spark, sf_dir)
    log = t.filter("txn % 10 <> 0").select("key", F.col("commit_ts").alias("log_ts"))
    o = table(spark, sf_dir, "orders").filter("o_orderkey % 10 = 0").select(F.col("o_orderkey").alias("txn"), (F.col("o_orderpriority") == "1-URGENT").alias("writes"))
    own = t.join(o.filter("writes").select(F.col("txn").alias("of")), F.col("txn") == F.col("of")).drop("of")
    lost = transactions.conflicts(own, log).select("txn").distinct().withColumn("lost", F.lit(True))
    return o.join(lost, "txn", "left").select("txn", "writes", F.col("lost").isNull().alias("ok"))


@query("sorted_scan_first_last", f"WITH {V} SELECT arg_min(key, {{'k': key, 't': commit_ts, 's': seq}}) AS first_key, arg_min(seq, {{'k': key, 't': commit_ts, 's': seq}}) AS first_seq, arg_max(key, {{'k': key, 't': commit_ts, 's': seq}}) AS last_key, arg_max(seq, {{'k': key, 't': commit_ts, 's': seq}}) AS last_seq FROM v")
def sorted_scan_first_last(spark, sf_dir):
    out = reads.first_and_last(versions(spark, sf_dir))
    return out.select(F.col("first.key").alias("first_key"), F.col("first.seq").alias("first_seq"), F.col("last.key").alias("last_key"), F.col("last.seq").alias("last_seq"))


@query("sorted_scan", f"WITH {V} SELECT key, commit_ts, seq, row_number() OVER (ORDER BY key, commit_ts, seq) AS place FROM v")
def sorted_scan(spark, sf_dir):
    """Versions with their place in the total order of the whole table."""
    return reads.ordered_places(versions(spark, sf_dir).select("key", "commit_ts", "seq"), fresh_folder(spark, "sorted-scan"))


@query("hidden_by_tombstone", f"WITH {V} SELECT key, x.commit_ts AS commit_ts FROM ({NEWEST} GROUP BY key) WHERE x.is_deleted")
def hidden_by_tombstone(spark, sf_dir):
    return reads.newest(versions(spark, sf_dir)).filter("is_deleted").select("key", "commit_ts")


@query("approx_keys", f"WITH {V} SELECT count(DISTINCT key) AS exact_keys, true AS within FROM v")
def approx_keys(spark, sf_dir):
    """The exact count, and that the estimate lies within four standard errors of it."""
    return aggregates.approximate_keys_checked(versions(spark, sf_dir)).select("exact_keys", "within")


def _store(spark: SparkSession, folder: str | None = None):
    from palimpsest.store import Store

    return Store(spark, StoreConfig(folder or fresh_folder(spark, "store"), log_level="ERROR"))


def _as_bytes(v: DataFrame) -> DataFrame:
    """Versions as a store has them: keys and values in bytes, tombstones without one."""
    return v.withColumn("key", codec.str_key(F.col("key").cast("string"))).withColumn("value", F.when(~F.col("is_deleted"), codec.str_key(F.col("value"))))


def _back(name: str):
    return F.decode(F.col(name), "UTF-8")


@query("store_round_trip", ORACLE["latest_live"])
def store_round_trip(spark, sf_dir):
    """Events written to a store in four runs, three of them compacted, and read
    back as the newest live values."""
    store, v = _store(spark), versions(spark, sf_dir)
    for part in range(4):
        store.append(_as_bytes(v.filter(F.col("seq") % 4 == part)))
    store.compact()
    return store.snapshot().select(_back("key").cast("long").alias("key"), "commit_ts", (F.col("seq") % F.lit(1 << 32)).alias("seq"), _back("value").alias("value"))


@query("txn_commit_path", """WITH c AS (SELECT c_custkey AS key, c_name AS name FROM customer WHERE c_custkey <= 300)
SELECT key, CASE WHEN key % 15 = 0 THEN NULL WHEN key % 3 = 0 THEN 'A' || key WHEN key % 7 = 0 THEN 'C' || key ELSE name END AS value, name AS seen_before, true AS second_lost, true AS own_seen FROM c""")
def txn_commit_path(spark, sf_dir):
    """Transactions of two writers, one with its clock an hour ahead, through a
    store: A and B write common keys and the second to commit loses, C writes
    others, D deletes after A. A reader that began first sees what was there."""
    rows = table(spark, sf_dir, "customer").filter("c_custkey <= 300").select(codec.str_key(F.col("c_custkey").cast("string")).alias("key"), codec.str_key(F.col("c_name")).alias("value"))
    one = _store(spark)
    one.append(rows)
    two = _store(spark, one.config.folder)
    two.clock.observe(one.clock.now() + 3_600_000_000_000)
    # 300 keys at most, by the filter above
    keys = sorted(int(bytes(r[0])) for r in rows.select("key").collect())
    reader, a, b, c = one.begin(), two.begin(), one.begin(), one.begin()
    for k in keys:
        if k % 3 == 0:
            a.set(b"%d" % k, b"A%d" % k)
        elif k % 7 == 0:
            c.set(b"%d" % k, b"C%d" % k)
        if k % 5 == 0:
            b.set(b"%d" % k, b"B%d" % k)
    own_seen = all(a.get(b"%d" % k) == b"A%d" % k for k in keys if k % 3 == 0)
    a.commit()
    try:
        b.commit()
        lost = False
    except ConflictError:
        lost = True
    c.commit()
    d = one.begin()
    for k in keys:
        if k % 15 == 0:
            d.delete(b"%d" % k)
    d.commit()
    before = reader.snapshot().select("key", F.col("value").alias("seen_before"))
    out = before.join(one.snapshot().select("key", "value"), "key", "left")
    return out.select(_back("key").cast("long").alias("key"), _back("value").alias("value"), _back("seen_before").alias("seen_before"), F.lit(lost).alias("second_lost"), F.lit(own_seen).alias("own_seen"))


DAYS = f"d AS (SELECT key, commit_ts // 86400000000 AS commit_ts, seq, value, is_deleted FROM v)"
LAST_OF_DAY = f"WITH {V}, {DAYS} SELECT key, commit_ts, CASE WHEN is_deleted THEN NULL ELSE value END AS value, is_deleted FROM d QUALIFY row_number() OVER (PARTITION BY key, commit_ts ORDER BY seq DESC) = 1"


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_bytes(versions(spark, sf_dir)).withColumn("commit_ts", F.floor(F.col("commit_ts") / 86400000000).cast("long"))


@query("log_replay", LAST_OF_DAY)
def log_replay(spark, sf_dir):
    """Events written as log files and replayed: of a key and day the entry written last counts."""
    binary.register(spark)
    folder = fresh_folder(spark, "log")
    Files(spark, folder).make("")
    binary.export_log(_days(spark, sf_dir), folder).count()
    out = binary.as_versions(spark.read.format("kv_log").load(folder))
    return out.select(_back("key").cast("long").alias("key"), "commit_ts", _back("value").alias("value"), "is_deleted")


def _run_files(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    folder = fresh_folder(spark, "run-files")
    Files(spark, folder).make("")
    rows = merge.last_writer_wins(_days(spark, sf_dir))
    # a row a file
    made = binary.export_runs(rows, folder, file_bytes=1 << 16).collect()
    return folder, spark.createDataFrame([(r["name"],) for r in made], "name string")


@query("run_files", LAST_OF_DAY)
def run_files(spark, sf_dir):
    """Versions written as binary run files and read back."""
    binary.register(spark)
    folder, _ = _run_files(spark, sf_dir)
    out = binary.as_versions(spark.read.format("kv_run").load(folder))
    return out.select(_back("key").cast("long").alias("key"), "commit_ts", _back("value").alias("value"), "is_deleted")


@query("run_file_lookup", f"WITH {V}, {DAYS}, n AS (SELECT key, arg_max({{'value': value, 'is_deleted': is_deleted, 't': commit_ts}}, {{'t': commit_ts, 's': seq}}) AS x FROM d WHERE commit_ts <= {S // 86400000000} AND key < 300 GROUP BY key) SELECT key, x.t AS commit_ts, x.value AS value FROM n WHERE NOT x.is_deleted")
def run_file_lookup(spark, sf_dir):
    """Reads of 300 keys at a time in binary run files, by their filters and indexes."""
    folder, names = _run_files(spark, sf_dir)
    found = binary.look_up(names.repartition(8), folder, [b"%d" % k for k in range(300)], S // 86400000000)
    out = found.groupBy("key").agg(F.max_by(F.struct("commit_ts", "value", "is_deleted"), "commit_ts").alias("x")).filter("NOT x.is_deleted")
    return out.select(_back("key").cast("long").alias("key"), "x.commit_ts", F.decode("x.value", "UTF-8").alias("value"))
