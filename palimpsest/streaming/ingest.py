"""Streams of versions.

The order of versions is that of their commit time and not of arrival, so late
rows need no watermark: they take their place in the key's history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from palimpsest.store import Store


def ingest(stream: DataFrame, store: Store, name: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append each micro-batch of (key, value[, is_deleted][, commit_ts][, seq])
    as one run. The manifest keeps the number of the last batch, so a batch that
    is replayed after a failure is taken in once."""

    def take(batch: DataFrame, number: int) -> None:
        store.append(batch, stream=(name, number))

    writer = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def newest_values(stream: DataFrame) -> DataFrame:
    """The newest version of each key as a streaming aggregation, for update or
    complete mode; one state row a key, tombstones included."""
    rest = [c for c in stream.columns if c != "key"]
    picked = stream.groupBy("key").agg(F.max_by(F.struct(*rest), F.struct("commit_ts", "seq")).alias("v"))
    return picked.select("key", *[F.col(f"v.{c}").alias(c) for c in rest])
