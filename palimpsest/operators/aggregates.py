"""Store statistics: one pass of partial sums each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.merge import version_bytes


def run_statistics(versions: DataFrame, by: str = "run") -> DataFrame:
    """Rows, bytes and least and greatest key of each run."""
    return versions.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_keys"), F.sum(version_bytes(F.col("key"), F.col("value"))).alias("bytes"),
        F.min("key").alias("min_key"), F.max("key").alias("max_key"),
    )


def version_counts(versions: DataFrame) -> DataFrame:
    """Versions and tombstones of each key."""
    return versions.groupBy("key").agg(F.count(F.lit(1)).alias("n_versions"), F.count_if("is_deleted").alias("n_tombstones"))


def totals(runs: DataFrame) -> DataFrame:
    """One row over a manifest: runs, rows and bytes."""
    zero = F.lit(0).cast("long")
    return runs.agg(F.count(F.lit(1)).alias("n_runs"), F.coalesce(F.sum("n_keys"), zero).alias("total_versions"), F.coalesce(F.sum("bytes"), zero).alias("total_bytes"))


def approximate_keys(versions: DataFrame, rsd: float = 0.02) -> DataFrame:
    """Distinct keys by HyperLogLog++: a fixed-size sketch a task."""
    return versions.agg(F.approx_count_distinct("key", rsd).alias("approx_keys"))


def approximate_keys_checked(versions: DataFrame, rsd: float = 0.02, widths: float = 4.0) -> DataFrame:
    """The estimate beside the exact count, and whether it is within so many standard errors."""
    out = versions.agg(F.approx_count_distinct("key", rsd).alias("approx_keys"), F.count_distinct("key").alias("exact_keys"))
    return out.withColumn("within", F.abs(F.col("approx_keys") - F.col("exact_keys")) <= F.greatest(F.lit(1.0), F.lit(widths * rsd) * F.col("exact_keys")))
