"""The joins behind transactions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overlay(base: DataFrame, writes: DataFrame) -> DataFrame:
    """Read-your-writes: buffered rows (key, value, is_deleted) shadow the
    snapshot's; keys whose buffered row is a tombstone are gone."""
    shadowed = base.join(writes.select("key"), "key", "left_anti").select("key", "value")
    return shadowed.unionByName(writes.filter("NOT is_deleted").select("key", "value"))


def conflicts(writes: DataFrame, log: DataFrame) -> DataFrame:
    """Rows of ``writes`` (txn, key, start_ts[, commit_ts]) whose key the log
    (key, log_ts) committed after the transaction began and, if the writes say
    when they commit, no later than that. A semi-join on the key with the times
    as residual, after the log is cut to one row a (key, time)."""
    log = log.select(F.col("key").alias("log_key"), "log_ts").distinct()
    when = (F.col("key") == F.col("log_key")) & (F.col("log_ts") > F.col("start_ts"))
    if "commit_ts" in writes.columns:
        when = when & (F.col("log_ts") <= F.col("commit_ts"))
    return writes.join(log, when, "left_semi")
