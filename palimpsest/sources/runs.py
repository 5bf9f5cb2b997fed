"""Sorted Parquet runs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from palimpsest.model import VERSIONS, StoreConfig
from palimpsest.operators.merge import last_writer_wins, version_bytes
from palimpsest.sources.files import Files
from palimpsest.sources.manifest import Manifest, Run


def write_run(versions: DataFrame, files: Files, config: StoreConfig, level: int, seq: int, merged: bool = False) -> Run | None:
    """Write versions as one run, sorted by (key, commit_ts) over all its files;
    None for no rows. Ranges of the key are dealt to tasks of the size that
    adaptive execution finds, and a range over key and time splits a hot key.
    The run is invisible until a manifest names it."""
    run_id = f"{level}_{seq}_{uuid.uuid4().hex[:12]}"
    name = f"runs/{run_id}"
    rows = versions if merged else last_writer_wins(versions)
    rows = rows.select(*VERSIONS.names).repartitionByRange("key", "commit_ts").sortWithinPartitions("key", "commit_ts")
    # the statistics are taken from the rows on their way into the files
    seen = Observation(run_id)
    rows = rows.observe(
        seen, F.count(F.lit(1)).alias("n"), F.sum(version_bytes(F.col("key"), F.col("value"))).alias("bytes"),
        F.min("key").alias("low"), F.max("key").alias("high"), F.min("commit_ts").alias("first"), F.max("commit_ts").alias("last"),
    )
    writer = rows.write
    if config.bloom_filter:
        writer = writer.option("parquet.bloom.filter.enabled#key", "true")
    writer.parquet(f"{files.folder}/{name}")
    got = seen.get
    if not got["n"]:
        files.delete(name)
        return None
    return Run(run_id, level, seq, name, got["n"], got["bytes"], files.size(name), bytes(got["low"]), bytes(got["high"]), got["first"], got["last"])


def read_runs(spark: SparkSession, paths: list[str]) -> DataFrame:
    if not paths:
        return spark.createDataFrame([], VERSIONS)
    return spark.read.schema(VERSIONS).parquet(*paths)


def runs_for(manifest: Manifest, low: bytes | None = None, high: bytes | None = None, after_ts: int | None = None, upto_ts: int | None = None) -> list[Run]:
    """Runs that can hold a key of [low, high] at a time in (after_ts, upto_ts]."""
    return [
        r for r in manifest.runs
        if (low is None or r.max_key >= low) and (high is None or r.min_key <= high) and (after_ts is None or r.max_ts > after_ts) and (upto_ts is None or r.min_ts <= upto_ts)
    ]
