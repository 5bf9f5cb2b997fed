"""Merges of runs: last writer wins, compaction and collection of old versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def last_writer_wins(versions: DataFrame) -> DataFrame:
    """One row a (key, commit_ts): that of the greatest seq. Copies meet after a
    partial aggregation, so a hot pair is one row a task before the shuffle."""
    rest = [c for c in versions.columns if c not in ("key", "commit_ts")]
    picked = versions.groupBy("key", "commit_ts").agg(F.max_by(F.struct(*rest), F.col("seq")).alias("v"))
    return picked.select(*[F.col(c) if c in ("key", "commit_ts") else F.col(f"v.{c}").alias(c) for c in versions.columns])


def merge_runs(runs: list[DataFrame]) -> DataFrame:
    """The union of runs with one row a (key, commit_ts)."""
    out = runs[0]
    for r in runs[1:]:
        out = out.unionByName(r)
    return last_writer_wins(out)


def collect_garbage(versions: DataFrame, horizon: int, drop_tombstones: bool = False, keep_from: int | None = None) -> DataFrame:
    """Versions that a read at ``horizon`` or later can see: all newer ones and of
    each key the newest at the horizon. With ``drop_tombstones`` (for the lowest
    level only) that one is dropped too if it is a tombstone. Rows whose seq is
    ``keep_from`` or more stay in any case.

    The newest old version of a key is an aggregate with partial sums in the map."""
    newer = F.col("commit_ts") > F.lit(horizon)
    if keep_from is not None:
        newer = newer | (F.col("seq") >= F.lit(keep_from))
    rest = [c for c in versions.columns if c != "key"]
    old = versions.filter(F.col("commit_ts") <= F.lit(horizon))
    kept = old.groupBy("key").agg(F.max_by(F.struct(*rest), F.struct("commit_ts", "seq")).alias("v")).select(*[F.col(c) if c == "key" else F.col(f"v.{c}").alias(c) for c in versions.columns])
    if keep_from is not None:
        kept = kept.filter(F.col("seq") < F.lit(keep_from))
    if drop_tombstones:
        kept = kept.filter("NOT is_deleted")
    return versions.filter(newer).unionByName(kept)


def compaction_groups(runs: list[dict], fan_in: int = 3, top_level: int = 2) -> list[list[dict]]:
    """Full groups of ``fan_in`` runs of one level, oldest first; what is left
    over stays, as do runs of ``top_level`` and above."""
    out = []
    for level in range(top_level):
        own = sorted((r for r in runs if r["level"] == level), key=lambda r: r["seq"])
        out += [own[i : i + fan_in] for i in range(0, len(own) - fan_in + 1, fan_in)]
    return out


def group_of_run(number: Column, fan_in: int = 3) -> Column:
    """Group of a run by its place (from 0) among the runs of its level."""
    return F.floor(number / F.lit(fan_in)).cast("long")


def version_bytes(key: Column, value: Column) -> Column:
    """Bytes of a version: encoded key and value; a tombstone's value is one byte."""
    return (F.octet_length(key) + 8 + F.coalesce(F.octet_length(value), F.lit(1))).cast("long")


def running_total(rows: DataFrame, order: str, amount: str, into: str, fan_out: int = 4096, _depth: int = 0) -> DataFrame:
    """Running sum of ``amount`` in order of a unique long column, at any size.

    Stretches of ``fan_out`` values of the order are summed first; the running
    sum over stretches is taken the same way until they are few, and added to
    the running sum inside each stretch. No task sees more than a stretch."""
    stretch_, sum_, upto_, of_, before_, inside_ = (f"_{n}{_depth}" for n in ("stretch", "sum", "upto", "of", "before", "inside"))
    own = rows.withColumn(stretch_, F.floor(F.col(order) / F.lit(fan_out)).cast("long"))
    sums = own.groupBy(stretch_).agg(F.sum(amount).alias(sum_))
    low, high = sums.agg(F.min(stretch_), F.max(stretch_)).first()
    upto = Window.orderBy(stretch_).rowsBetween(Window.unboundedPreceding, 0)
    if low is None or high - low < fan_out:
        totals = sums.withColumn(upto_, F.sum(sum_).over(upto))
    else:
        totals = running_total(sums, stretch_, sum_, upto_, fan_out, _depth + 1)
    before = totals.select(F.col(stretch_).alias(of_), (F.col(upto_) - F.col(sum_)).alias(before_))
    inside = Window.partitionBy(stretch_).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = own.withColumn(inside_, F.sum(amount).over(inside)).join(before, F.col(stretch_) == F.col(of_))
    return out.select(*rows.columns, (F.col(before_) + F.col(inside_)).alias(into))


def plan_flushes(rows: DataFrame, order: str, amount: str, budget: int) -> DataFrame:
    """Rows with the number of the run that a byte budget puts them in."""
    out = running_total(rows, order, amount, "_total")
    return out.withColumn("run", F.floor((F.col("_total") - F.col(amount)) / F.lit(budget)).cast("long")).drop("_total")
