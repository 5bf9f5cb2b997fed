"""A versioned, ordered key-value analytics engine on Spark.

Every write is a row ``(key, commit_ts, seq, value, is_deleted)`` in a sorted,
immutable Parquet run; a store is the list of runs that its latest manifest
names. Reads at a timestamp, ranges, histories, transactions and compactions are
DataFrame plans over those rows.
"""

from palimpsest.model import (
    ConflictError,
    KeyCodecError,
    StoreConfig,
    StoreError,
    TxnAborted,
    TxnCommitted,
    VERSIONS,
)
from palimpsest.store import Store

__all__ = ["ConflictError", "KeyCodecError", "Store", "StoreConfig", "StoreError", "TxnAborted", "TxnCommitted", "VERSIONS"]
