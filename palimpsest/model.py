"""Schemas, configuration and errors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

#: One row a version. ``seq`` is the order of insertion: of rows with equal key
#: and commit_ts the greatest seq counts.
VERSIONS = T.StructType([
    T.StructField("key", T.BinaryType(), False),
    T.StructField("commit_ts", T.LongType(), False),
    T.StructField("seq", T.LongType(), False),
    T.StructField("value", T.BinaryType(), True),
    T.StructField("is_deleted", T.BooleanType(), False),
])

#: Columns that order a store's rows.
ORDER = ("key", "commit_ts", "seq")


class StoreError(Exception):
    """Base of this engine's errors."""


class NullKeyError(StoreError):
    """A key is null."""


class KeyCodecError(StoreError):
    """Bytes are no encoded key."""


class FormatError(StoreError):
    """A binary file is cut off or inconsistent."""


class ManifestConflict(StoreError):
    """Another writer published a manifest first."""


class TxnError(StoreError):
    """Base of the transaction errors."""


class ConflictError(TxnError):
    """A key of the write set was committed by another transaction after this one began."""


class TxnCommitted(TxnError):
    """The transaction is already committed."""


class TxnAborted(TxnError):
    """The transaction is aborted or rolled back."""


@dataclass(frozen=True)
class StoreConfig:
    """Where a store lies and how it writes.

    ``memtable_bytes`` is the budget of single writes held in one memtable and its
    log, and ``max_frozen`` the full memtables that may wait to be written;
    ``fan_in`` runs of one level become one of the next, below ``top_level``."""

    folder: str
    memtable_bytes: int = 64 << 20
    clear_on_start: bool = False
    log_level: str = "INFO"
    fan_in: int = 3
    top_level: int = 2
    max_frozen: int = 2
    bloom_filter: bool = True


def default_config(folder: str) -> StoreConfig:
    return StoreConfig(folder)
