"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.sources.files import fresh_folder, shared_folder  # noqa: F401

#: A word of the corpus contracts: a run of anything but space and \t \n \v \f \r.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

#: Most bytes of an Arrow batch but for its last row, of any length: with the usual
#: bound by rows alone, long texts would set how much a task holds.
BATCH_BYTES = 4 << 20
#: Texts that are Python objects at a time inside one Arrow batch.
SLICE_ROWS = 64


def words_of(text: str) -> list[bytes]:
    """Words of a text as UTF-8. ``bytes.split`` cuts at exactly the six
    characters of WORD_PATTERN, as no byte of a longer code point is among them."""
    return text.encode("utf-8", "surrogatepass").split()


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: write to the shared folder and read again. A lost executor
    then costs a reread and never a second run of what is upstream. The table
    stays until ``palimpsest.sources.files.release`` is called."""
    path = fresh_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh_name(taken: list[str], base: str) -> str:
    """A column name that clashes with none of the taken ones (Spark compares
    without case)."""
    lower, name = {t.lower() for t in taken}, base
    while name.lower() in lower:
        name = "_" + name
    return name


def texts(batch: pa.Array) -> Iterator[list[str | None]]:
    """An Arrow array's strings, a bounded number of Python objects at a time."""
    for start in range(0, len(batch), SLICE_ROWS):
        yield batch.slice(start, SLICE_ROWS).to_pylist()


#: What this worker keeps between tasks: a key, and the model loaded under it.
_held: list = [None, None]


def held(key, make: Callable | None = None):
    """The model of ``key``, loaded once and kept until tasks of another key run in
    this worker. Then it goes with its memos, and its memory returns to the system:
    workers outlive their stages, and one that kept every operator's model would
    hold them all. ``make`` None: an operator without a model."""
    if _held[0] != key:
        _held[:] = [None, None]
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)
        _held[:] = [key, make() if make else None]
    return _held[1]


def text_udf(per_text: Callable, schema: str, arrow_type: pa.StructType) -> Callable[..., Column]:
    """A scalar Arrow UDF of one text column that returns a struct.

    ``per_text`` gets a string (null as empty) and returns a dict. Marked as
    non-deterministic only so that Catalyst evaluates it once."""

    @F.arrow_udf(schema)
    def run(col: pa.Array) -> pa.Array:
        parts = [pa.array([per_text(t or "") for t in part], arrow_type) for part in texts(col)]
        return pa.concat_arrays(parts) if parts else pa.array([], arrow_type)

    return run.asNondeterministic()


def _bytes(size: str) -> int:
    """A Spark size setting in bytes: a number with a unit such as k or mb, or none (bytes)."""
    digits = size.strip().lower().rstrip("bkmgtp")
    unit = size.strip().lower()[len(digits) :].rstrip("b")
    return int(digits) << 10 * (" kmgtp".index(unit) if unit else 0)


def ship(spark: SparkSession) -> None:
    """Give executors this package through Spark's own file server, once a context,
    and bound the bytes of the session's Arrow batches by BATCH_BYTES."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if _bytes(spark.conf.get(name)) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))
    context, root = spark.sparkContext, Path(__file__).resolve().parent.parent
    if getattr(context, "_palimpsest_shipped", False):
        return
    kept = Path(tempfile.mkdtemp(prefix="palimpsest-ship-")) / "palimpsest.zip"
    with zipfile.ZipFile(kept, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, Path(root.name) / p.relative_to(root))
    context.addPyFile(str(kept))
    context._palimpsest_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
