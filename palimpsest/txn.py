"""Transactions: snapshot isolation, own writes first, first committer wins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.model import ConflictError, TxnAborted, TxnCommitted
from palimpsest.operators import reads, transactions
from palimpsest.sources.runs import read_runs
from palimpsest.store import FEW_KEYS, SEQ_BITS, Store

WRITES = "key binary, value binary, is_deleted boolean"


class Transaction:
    """Reads see the store's view at the start, which stays what it is whatever is
    written or collected later, and the transaction's own writes.

    Commit writes all of them as one run under one manifest, so readers see all
    or none. It fails if a key of the write set was written after the start. What
    comes after is told by the order of manifests and not by clocks: rows written
    since carry a seq of a later run, in whatever process and at whatever time."""

    def __init__(self, store: Store):
        with store.lock:
            store.refresh()
            self.store, self.view = store, store.view()
            self.start_ts = store.clock.now()
            self.state = "active"
            store.open.add(self)
        self.writes: dict[bytes, bytes | None] = {}

    def _check(self) -> None:
        if self.state == "committed":
            raise TxnCommitted("the transaction is committed")
        if self.state == "aborted":
            raise TxnAborted("the transaction is aborted")

    def get(self, key: bytes) -> bytes | None:
        self._check()
        if key in self.writes:
            return self.writes[key]
        return self.store.get(key, self.start_ts, self.view)

    def set(self, key: bytes, value: bytes) -> None:
        self._check()
        self.writes[key] = value

    def delete(self, key: bytes) -> None:
        self._check()
        self.writes[key] = None

    def _frame(self) -> DataFrame:
        return self.store.spark.createDataFrame([(bytearray(k), None if v is None else bytearray(v), v is None) for k, v in self.writes.items()], WRITES)

    def snapshot(self) -> DataFrame:
        """All (key, value) that the transaction sees."""
        self._check()
        return transactions.overlay(self.store.snapshot(self.start_ts, self.view), self._frame())

    def range(self, low: bytes, high: bytes) -> DataFrame:
        """(key, value) of an inclusive range that the transaction sees."""
        self._check()
        base = self.store.range(low, high, self.start_ts, self.view)
        return reads.key_range(transactions.overlay(base, self._frame()), bytearray(low), bytearray(high))

    def _conflicts(self, manifest) -> bool:
        """Whether a key of the write set has a row, in a run of the manifest or in
        this process's memory, that was written after the start."""
        start, began = self.view.manifest, self.view
        if start.next_seq < manifest.whole_from:
            return True  # rows that could tell have been collected
        with self.store.lock:
            now = self.store.view()
            known = {(k, ts) for k in self.writes for k, ts, n, _ in began.rows(k, k)}
            if any(n > began.upto for k in self.writes for _, _, n, _ in now.rows(k, k)):
                return True
        low, high = min(self.writes), max(self.writes)
        runs = [r for r in manifest.runs if r.seq >= start.next_seq and r.max_key >= low and r.min_key <= high]
        if not runs:
            return False
        later = read_runs(self.store.spark, self.store._paths(runs)).filter(F.col("seq") >= F.lit(start.next_seq << SEQ_BITS)).select("key", "commit_ts")
        if len(self.writes) <= FEW_KEYS:
            later = later.filter(F.col("key").isin([bytearray(k) for k in self.writes]))
        else:
            later = reads.only_keys(later, self._frame())
        if known:  # the start saw these in memory, and they have come to a run since
            later = later.join(self.store.spark.createDataFrame([(bytearray(k), t) for k, t in known], "key binary, commit_ts long"), ["key", "commit_ts"], "left_anti")
        return not later.isEmpty()

    def commit(self) -> int | None:
        """Commit and return the commit timestamp, None if nothing was written.
        The test runs against each manifest that the commit is to follow."""
        self._check()
        if not self.writes:
            self.state = "committed"
            return None

        def check(manifest) -> None:
            if self._conflicts(manifest):
                self.state = "aborted"
                raise ConflictError("another transaction has committed a key of the write set")

        ts = self.store.append(self._frame(), check=check)
        self.state = "committed"
        return ts

    def rollback(self) -> None:
        self._check()
        self.writes.clear()
        self.state = "aborted"

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, kind, *_) -> None:
        if self.state == "active":
            self.rollback() if kind else self.commit()
