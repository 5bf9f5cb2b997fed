"""Reads of versions: lookups at a timestamp, ranges, snapshots and histories.

All take a DataFrame with the columns of ``model.VERSIONS``; key, value and
timestamp may be of any orderable type. The version is picked first and
tombstones are dropped after it, so a deleted key does not come back.

Aggregations have partial sums. What needs the order of a key's versions is cut
into time buckets, so that one key with a third of all versions is spread: a
task sorts one bucket of a key, and only one row a bucket crosses between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: What rows of a store are ordered by.
ORDER = ("key", "commit_ts", "seq")
#: Buckets that a table's time range is cut into.
TIME_BUCKETS = 64
#: Most probes, and bytes of their keys as a hash table, that are sent to every task.
FEW_PROBES, FEW_BYTES = 200_000, 32 << 20
#: Rows that one task may order, should they all be of one key.
ONE_TASK = 4_000_000


def _none(d: DataFrame) -> DataFrame:
    return d.filter(F.lit(False))


def as_of_filter(versions: DataFrame, as_of: int | None) -> DataFrame:
    return versions if as_of is None else versions.filter(F.col("commit_ts") <= F.lit(as_of))


def newest(versions: DataFrame, as_of: int | None = None) -> DataFrame:
    """The newest version of each key at ``as_of``, tombstones included."""
    rest = [c for c in versions.columns if c != "key"]
    pick = F.max_by(F.struct(*rest), F.struct("commit_ts", "seq")).alias("v")
    return as_of_filter(versions, as_of).groupBy("key").agg(pick).select("key", *[F.col(f"v.{c}").alias(c) for c in rest])


def live(versions: DataFrame) -> Column:
    return ~F.col("is_deleted")


def snapshot(versions: DataFrame, as_of: int | None = None) -> DataFrame:
    """All live keys at ``as_of`` with their newest version."""
    return newest(versions, as_of).filter("NOT is_deleted")


def get(versions: DataFrame, key, as_of: int | None = None) -> DataFrame:
    """The live version of one key: one row or none. The key's filter reaches the scan."""
    return snapshot(versions.filter(F.col("key") == F.lit(key)), as_of)


def get_many(versions: DataFrame, keys: DataFrame, as_of: int | None = None) -> DataFrame:
    """The live versions of many keys at one time: the newest versions, summed in
    the map, semi-joined with the keys on the distribution they already have."""
    return snapshot(versions, as_of).join(keys.select("key"), "key", "left_semi")


def key_range(versions: DataFrame, low, high) -> DataFrame:
    """Versions with low <= key <= high. An inverted range is known to be empty
    here, where Spark would scan for it."""
    if low > high:
        return _none(versions)
    return versions.filter(F.col("key").between(F.lit(low), F.lit(high)))


def range_scan(versions: DataFrame, low, high, as_of: int | None = None) -> DataFrame:
    """Live keys of an inclusive range at ``as_of``."""
    return snapshot(key_range(versions, low, high), as_of)


def range_versions(versions: DataFrame, low, high, deleted: bool = True) -> DataFrame:
    """All versions of an inclusive range, one a (key, commit_ts)."""
    from palimpsest.operators.merge import last_writer_wins

    out = last_writer_wins(key_range(versions, low, high))
    return out if deleted else out.filter("NOT is_deleted")


def ordered(versions: DataFrame) -> DataFrame:
    """Versions in total order: bytes of the key, then time."""
    return versions.orderBy("key", "commit_ts", "seq")


def ordered_places(versions: DataFrame, folder: str) -> DataFrame:
    """Versions with their ``place`` (from 1) in the total order, at any size.

    The rows are dealt by ranges of the order, sorted inside each and written to
    ``folder`` in the shared file system, each with its range and its number in it,
    so that what is counted and what is placed are the same ranges. One row a range
    is summed up before it. No task sees more than a range, and ranges cut keys too."""
    dealt = versions.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    dealt.withColumn("_nth", F.monotonically_increasing_id()).write.parquet(folder)
    rows = versions.sparkSession.read.parquet(folder)
    # the upper bits of the number are those of the range, the lower 33 count its rows
    rows = rows.withColumn("_range", F.shiftright("_nth", 33)).withColumn("_inside", F.col("_nth").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("_range").alias("_of"), "_n").withColumn("_start", F.coalesce(F.sum("_n").over(upto), F.lit(0).cast("long"))).drop("_n")
    out = rows.join(starts, F.col("_range") == F.col("_of"))
    return out.select(*versions.columns, (F.col("_start") + F.col("_inside") + 1).alias("place"))


def first_and_last(versions: DataFrame) -> DataFrame:
    """One row with the first and the last version in total order."""
    row, at = F.struct(*versions.columns), F.struct("key", "commit_ts", "seq")
    return versions.agg(F.min_by(row, at).alias("first"), F.max_by(row, at).alias("last"))


def _bucket(ts: Column, low: int, width: int) -> Column:
    return F.floor((ts - F.lit(low)) / F.lit(width)).cast("long")


def _time_range(*parts: tuple[DataFrame, str]) -> tuple[int, int] | None:
    """Least and greatest timestamp: one pass over numbers, two values to the driver."""
    found = [tuple(d.agg(F.min(c).cast("long"), F.max(c).cast("long")).first()) for d, c in parts]
    found = [x for x in found if x[0] is not None]
    return (min(a for a, _ in found), max(b for _, b in found)) if found else None


def _few_keys(probes: DataFrame, rows: int, longest: int) -> DataFrame | None:
    """The probes' keys, if their number and longest key prove them small enough to be sent to every task."""
    return F.broadcast(probes.select("key").distinct()) if rows <= FEW_PROBES and rows * (longest + 64) <= FEW_BYTES else None


def multi_get(versions: DataFrame, probes: DataFrame, probe_ts: str = "probe_ts", buckets: int = TIME_BUCKETS, span: tuple[int, int] | None = None,
              most: int | None = None, one_task: int = ONE_TASK) -> DataFrame:
    """Many lookups at their own timestamps as one plan: each row of ``probes``
    (key, probe_ts, ...) with the columns of the live version it sees (inner).

    Versions and probes are united and dealt once by (key, time bucket); in order
    of time a probe finds the newest version of its bucket. A bucket whose first
    probe comes before its first version asks the buckets before it: one row of
    numbers a bucket finds the version, which is then fetched. No pair of probe
    and version is made besides the result. Of few keys only their versions are
    shuffled at all. ``span`` is a range that holds all versions' times and
    ``most`` a bound on their number, where they are known; with no more than
    ``one_task`` rows in all no key can be too much for a task, and one bucket
    does. Probes after the span count as at its end. Rows of equal key, time and
    seq have to be merged before."""
    n, longest = probes.agg(F.count(F.lit(1)), F.max(F.octet_length(F.col("key").cast("string")))).first()
    keys = _few_keys(probes, n, longest or 0)
    if keys is not None:
        versions = versions.join(keys, "key", "left_semi")
    if span is None or most is None:
        most, *found = versions.agg(F.count(F.lit(1)), F.min("commit_ts"), F.max("commit_ts")).first()
        span = tuple(found) if most else (0, 0)
    if most + n <= one_task:
        buckets = 1
    low, high = span
    width = max(1, -(-(high - low + 1) // buckets))
    where = lambda ts: F.lit(0).cast("long") if buckets == 1 else _bucket(F.least(ts, F.lit(high)), low, width)
    own = [c for c in probes.columns if c not in ("key", probe_ts)]
    row = F.struct(*[c for c in versions.columns if c != "key"])
    v = versions.select("key", where(F.col("commit_ts")).alias("b"), F.col("commit_ts").alias("t"), F.col("seq").alias("nth"), row.alias("v"), F.lit(None).alias("p"))
    # a probe comes after all versions of its time
    p = probes.select("key", where(F.col(probe_ts)).alias("b"), F.col(probe_ts).alias("t"), F.lit((1 << 63) - 1).alias("nth"), F.lit(None).alias("v"), F.struct(F.lit(1).alias("one"), *own).alias("p"))
    both = v.unionByName(p)
    upto = Window.partitionBy("key", "b").orderBy("t", "nth").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("v", F.last("v", ignorenulls=True).over(upto)).filter("p IS NOT NULL")
    if buckets > 1:
        is_version = F.col("p").isNull()
        ends = both.groupBy("key", "b").agg(F.max(F.when(is_version, F.col("t"))).alias("end"), F.min(F.when(is_version, F.col("t"))).alias("first"), F.min(F.when(~is_version, F.col("t"))).alias("asked"))
        before = Window.partitionBy("key").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
        asks = ends.withColumn("at", F.last("end", ignorenulls=True).over(before)).filter("at IS NOT NULL AND asked IS NOT NULL AND (first IS NULL OR asked < first)")
        asks = asks.select(F.col("key").alias("of"), F.col("b").alias("of_b"), "at")
        fetched = versions.join(asks, (F.col("key") == F.col("of")) & (F.col("commit_ts") == F.col("at"))).groupBy("of", "of_b").agg(F.max_by(row, F.col("seq")).alias("carried"))
        seen = seen.join(fetched, (F.col("key") == F.col("of")) & (F.col("b") == F.col("of_b")), "left").withColumn("v", F.coalesce("v", "carried"))
    rest = [F.col(f"v.{c}").alias(c) for c in versions.columns if c != "key"]
    return seen.filter("v IS NOT NULL AND NOT v.is_deleted").select("key", F.col("t").alias(probe_ts), *[F.col(f"p.{c}").alias(c) for c in own], *rest)


def multi_get_by_join(versions: DataFrame, probes: DataFrame, probe_ts: str = "probe_ts") -> DataFrame:
    """As ``multi_get``, by an equi-join with a residual and ``max_by``: for few
    probes, or few versions a key, where the joined pairs stay near their number."""
    own = [c for c in probes.columns if c != "key"]
    p = probes.withColumn("_probe", F.monotonically_increasing_id()).withColumnRenamed("key", "probe_key")
    pairs = p.join(versions, (F.col("probe_key") == F.col("key")) & (F.col("commit_ts") <= F.col(probe_ts)))
    rest = [c for c in versions.columns if c != "key"]
    best = pairs.groupBy("_probe", "key", *own).agg(F.max_by(F.struct(*rest), F.struct("commit_ts", "seq")).alias("v"))
    return best.filter("NOT v.is_deleted").select("key", *own, *[F.col(f"v.{c}").alias(c) for c in rest])


def history(versions: DataFrame, buckets: int = TIME_BUCKETS) -> DataFrame:
    """Each version with the time ``valid_to`` (exclusive) at which the next one
    of its key takes over; null for the newest. Rows of equal key and commit_ts
    have to be merged before."""
    span = _time_range((versions, "commit_ts"))
    low, high = span or (0, 0)
    width = max(1, -(-(high - low + 1) // buckets))
    rows = versions.withColumn("b", _bucket(F.col("commit_ts"), low, width))
    starts = rows.groupBy("key", "b").agg(F.min("commit_ts").alias("start"))
    after = starts.select("key", "b", F.lead("start").over(Window.partitionBy("key").orderBy("b")).alias("next_bucket"))
    # the one row a bucket whose next version lies outside its bucket asks the short table
    inside = F.lead("commit_ts").over(Window.partitionBy("key", "b").orderBy("commit_ts", "seq"))
    rows = rows.withColumn("inside", inside)
    joined = rows.join(after.withColumnRenamed("key", "k2").withColumnRenamed("b", "b2"), (F.col("key") == F.col("k2")) & (F.col("b") == F.col("b2")), "left")
    return joined.select(*versions.columns, F.coalesce("inside", "next_bucket").alias("valid_to"))


def prune_runs(runs: DataFrame, low, high=None) -> DataFrame:
    """Runs (min_key, max_key, ...) whose key range meets [low, high]."""
    high = low if high is None else high
    if low > high:
        return _none(runs)
    return runs.filter((F.col("min_key") <= F.lit(high)) & (F.col("max_key") >= F.lit(low)))


def only_keys(versions: DataFrame, keys: DataFrame) -> DataFrame:
    """Versions of the given keys, by an exact semi-join."""
    return versions.join(keys.select("key").distinct(), "key", "left_semi")
