"""The store: sorted runs under a manifest, a memtable with a log, reads, compaction.

One process writes single keys (``set``, ``delete``) at a time; batches
(``append``) and transactions may come from several, as each publishes the next
manifest or starts over. All reads take a view, one manifest and the memtables as
of their start, and return DataFrames, but for ``get``, which returns bytes.

A memtable over its budget is frozen and written as a run by a worker thread;
writes go on into the next one, and wait only while ``max_frozen`` are unwritten."""

from __future__ import annotations

import threading
import time
import uuid
import weakref
from concurrent.futures import Future, ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.codec import Clock
from palimpsest.log import JsonLogger
from palimpsest.memtable import Log, Memtable, View, dump_entry, load_entries, lock
from palimpsest.model import VERSIONS, ManifestConflict, NullKeyError, StoreConfig, StoreError
from palimpsest.operators import merge, reads
from palimpsest.sources import manifest as manifests
from palimpsest.sources.binary import load_log
from palimpsest.sources.files import Files
from palimpsest.sources.runs import read_runs, runs_for, write_run

#: Low bits of seq that number the rows of one run.
SEQ_BITS = 32
#: Longest list of keys that is written into a filter.
FEW_KEYS = 500
#: Time after which a run that no manifest has named counts as left over from a writer that died.
ORPHAN_SECONDS = 86_400


class Store:
    def __init__(self, spark: SparkSession, config: StoreConfig | str):
        self.spark = spark
        self.config = StoreConfig(config) if isinstance(config, str) else config
        self.log = JsonLogger(level=self.config.log_level)
        self.files = Files(spark, self.config.folder)
        if self.config.clear_on_start and self.files.exists(""):
            for name in ("manifest", "runs", "wal"):
                if self.files.exists(name):
                    self.files.delete(name)
        for name in ("manifest", "runs", "wal"):
            self.files.make(name)
        self.manifest = manifests.latest(self.files)
        self.clock = Clock(self.manifest.clock)
        self.owner, self.number = uuid.uuid4().hex[:12], 0
        self.memory, self.frozen = Memtable(), ()
        self.lock = threading.RLock()
        self.worker: ThreadPoolExecutor | None = None
        self.flushes: list[Future] = []
        self.open: weakref.WeakSet = weakref.WeakSet()
        self._recover()

    # ------------------------------------------------------------ single writes

    def _recover(self) -> None:
        """Take over the logs of processes that are gone; those of living ones are
        locked and stay theirs."""
        if not self.files.local:
            return
        for name in self.files.names("wal"):
            taken = Log.__new__(Log)
            taken.path, taken.size = self.files.local_path(f"wal/{name}"), 0
            try:
                taken.file = open(taken.path, "ab")
            except FileNotFoundError:
                continue
            if not lock(taken.file):
                taken.close()
                continue
            data = self.files.read(f"wal/{name}")
            for key, ts, value in load_log(data, strict=False) if name.endswith((".log", ".imm")) else load_entries(data):
                self._remember(key, ts, value)
                self.clock.observe(ts)
            self.memory.logs.insert(0, taken)

    def _remember(self, key: bytes, ts: int, value: bytes | None) -> None:
        self.number += 1
        self.memory.put(key, ts, value, self.number, keep=bool(self.open))

    def set(self, key: bytes, value: bytes | None, ts: int | None = None) -> int:
        """Write a version and return its timestamp. Over the budget a new key
        freezes the memtable first; an existing one is updated in place. The entry
        is in the log, on disk, before it is in memory. On a folder that is not
        local there is no log: there call ``flush`` to make writes last."""
        if key is None:
            raise NullKeyError("a key may not be null")
        key, value = bytes(key), None if value is None else bytes(value)
        with self.lock:
            ts = self.clock.now() if ts is None else ts
            size = len(key) + 8 + (1 if value is None else len(value))
            if len(self.memory) and (key, ts) not in self.memory and self.memory.bytes + size > self.config.memtable_bytes:
                self.freeze()
            if self.files.local:
                # recovered logs are read only: an entry of this process goes into one of its own
                if not self.memory.logs or self.owner not in self.memory.logs[-1].path:
                    self.memory.logs.append(Log(self.files.local_path(f"wal/{self.owner}-{time.time_ns()}.wal")))
                self.memory.logs[-1].append(dump_entry(key, ts, value))
            self._remember(key, ts, value)
        self.barrier(self.config.max_frozen)
        return ts

    def delete(self, key: bytes, ts: int | None = None) -> int:
        return self.set(key, None, ts)

    def view(self) -> View:
        with self.lock:
            return View(self.manifest, (*self.frozen, self.memory), self.number)

    def _memory_frame(self, view: View, low: bytes | None = None, high: bytes | None = None) -> DataFrame | None:
        """The memtables' rows of a range, numbered after all that runs hold."""
        with self.lock:
            rows = view.rows(low, high)
        base, first = view.manifest.next_seq << SEQ_BITS, min((r[2] for r in rows), default=0)
        return self.spark.createDataFrame([(bytearray(k), ts, base + n - first, None if v is None else bytearray(v), v is None) for k, ts, n, v in rows], VERSIONS) if rows else None

    def freeze(self) -> None:
        """Put a new memtable in place of a full one, which the worker writes as a run."""
        with self.lock:
            if not len(self.memory):
                return
            full, self.memory = self.memory, Memtable()
            self.frozen = (*self.frozen, full)
            if self.worker is None:
                self.worker = ThreadPoolExecutor(1, "palimpsest-flush")
            self.flushes.append(self.worker.submit(self._write, full))

    def _write(self, full: Memtable) -> None:
        """Write a frozen memtable as a run of level 0; then its log goes."""
        rows = [(bytearray(k), ts, n - full.first, None if v is None else bytearray(v), v is None) for k, ts, n, v in full.rows(None, None, 1 << 62)]

        def make(m, ts):
            frame = self.spark.createDataFrame(rows, VERSIONS)
            return write_run(frame.withColumn("seq", F.col("seq") + F.lit(m.next_seq << SEQ_BITS)), self.files, self.config, 0, m.next_seq)

        self._publish(make, written=full)
        for log in full.logs:
            log.drop()

    def barrier(self, most: int = 0) -> None:
        """Wait until at most so many frozen memtables are unwritten; a failure of
        the worker is raised here, and its memtable is tried again by the next flush."""
        while True:
            with self.lock:
                if len(self.flushes) <= most:
                    return
                oldest = self.flushes[0]
            try:
                oldest.result()
            finally:
                with self.lock:
                    if self.flushes and self.flushes[0] is oldest:
                        self.flushes.pop(0)

    def flush(self) -> None:
        """Write all that is in memory as runs and wait for it."""
        self.freeze()
        self.barrier()
        with self.lock:
            again = [self.worker.submit(self._write, t) for t in self.frozen]
            self.flushes += again
        self.barrier()

    def close(self) -> None:
        self.flush()
        if self.worker is not None:
            self.worker.shutdown()
            self.worker = None

    # ------------------------------------------------------------ batches

    def _publish(self, make, check=None, stream: tuple[str, int] | None = None, written: Memtable | None = None) -> int | None:
        """Write a run against the latest manifest and publish it, again if
        another writer was first; each attempt takes a time past all that the
        manifest knows, and the last one's is returned. ``check`` may refuse each
        new manifest. ``written`` is the frozen memtable that the run holds."""
        while True:
            now = manifests.latest(self.files)
            self.clock.observe(now.clock)
            ts = self.clock.now()
            if stream and now.streams.get(stream[0], -1) >= stream[1]:
                self._see(now, written)
                return None
            if check is not None:
                check(now)
            run = make(now, ts)
            streams = {**now.streams, stream[0]: stream[1]} if stream else now.streams
            new = now.next(next_seq=now.next_seq + 1, clock=max(now.clock, self.clock.last), runs=(*now.runs, run) if run else now.runs, streams=streams)
            try:
                self._see(manifests.publish(self.files, new), written)
                self.log.debug("published", manifest=new.number, run=run.run_id if run else None)
                return ts
            except ManifestConflict:
                if run:
                    self.files.delete(run.path)

    def _see(self, manifest, written: Memtable | None = None) -> None:
        """Take a manifest for new views, together with the memtable it makes spare."""
        with self.lock:
            if manifest.number >= self.manifest.number:
                self.manifest = manifest
            self.clock.observe(manifest.clock)
            if written is not None:
                self.frozen = tuple(t for t in self.frozen if t is not written)

    def append(self, batch: DataFrame, ts: int | None = None, check=None, stream: tuple[str, int] | None = None) -> int | None:
        """Write a DataFrame (key, value[, is_deleted][, commit_ts][, seq]) as one
        run and publish it at once; returns its time. ``seq`` (under 2^32) orders
        rows of equal key and time; without it one of them stays. Null keys are an error."""
        has = set(batch.columns)

        def make(m, now):
            order = F.col("seq").cast("long") if "seq" in has else F.lit(0).cast("long")
            key = F.when(F.col("key").isNull(), F.raise_error(F.lit("a key may not be null"))).otherwise(F.col("key").cast("binary"))
            rows = batch.select(
                key.alias("key"), (F.col("commit_ts").cast("long") if "commit_ts" in has else F.lit(now if ts is None else ts)).alias("commit_ts"),
                (F.lit(m.next_seq << SEQ_BITS) + order).alias("seq"), F.col("value").cast("binary").alias("value"),
                (F.coalesce("is_deleted", F.lit(False)) if "is_deleted" in has else F.lit(False)).alias("is_deleted"),
            )
            return write_run(rows, self.files, self.config, 0, m.next_seq)

        at = self._publish(make, check, stream)
        return at if ts is None else ts

    # ------------------------------------------------------------ reads

    def _paths(self, runs) -> list[str]:
        return [f"{self.files.folder}/{r.path}" for r in runs]

    def versions(self, low: bytes | None = None, high: bytes | None = None, after_ts: int | None = None, upto_ts: int | None = None, view: View | None = None) -> DataFrame:
        """All versions of runs that can hold what is asked for, and the memtables' of the range."""
        view = view or self.view()
        out = read_runs(self.spark, self._paths(runs_for(view.manifest, low, high, after_ts, upto_ts)))
        memory = self._memory_frame(view, low, high)
        return out if memory is None else out.unionByName(memory)

    def get(self, key: bytes, as_of: int | None = None, view: View | None = None) -> bytes | None:
        """The value of a key at a time, None if it has none. The newest version of
        memtables and runs counts, wherever it lies; without a run whose key and
        time range can hold a newer one than memory has, no job runs."""
        key, view = bytes(key), view or self.view()
        with self.lock:
            held = view.newest(key, as_of)
        runs = runs_for(view.manifest, key, key, held[0] if held else None, as_of)
        if runs:
            rows = reads.newest(read_runs(self.spark, self._paths(runs)).filter(F.col("key") == F.lit(bytearray(key))), as_of).select("commit_ts", "value", "is_deleted").collect()
            if rows and (held is None or rows[0][0] > held[0]):
                return None if rows[0][2] else bytes(rows[0][1] or b"")
        return held[2] if held else None

    def get_many(self, keys: DataFrame, as_of: int | None = None) -> DataFrame:
        """Live versions of the keys of a DataFrame (key), all at one time."""
        return reads.get_many(self.versions(upto_ts=as_of), keys, as_of)

    def multi_get(self, probes: DataFrame, **options) -> DataFrame:
        """Many lookups at times of their own; the range of times comes from the manifest."""
        view = self.view()
        with self.lock:
            times = [ts for _, ts, _, _ in view.rows()]
        times += [t for r in view.manifest.runs for t in (r.min_ts, r.max_ts)]
        most = len(times) + sum(r.n_keys for r in view.manifest.runs)
        return reads.multi_get(self.versions(view=view), probes, span=(min(times), max(times)) if times else (0, 0), most=most, **options)

    def range(self, low: bytes, high: bytes, as_of: int | None = None, view: View | None = None) -> DataFrame:
        """Live (key, value) of an inclusive range at a time."""
        if low > high:
            return self.spark.createDataFrame([], "key binary, value binary")
        return reads.range_scan(self.versions(low, high, upto_ts=as_of, view=view), bytearray(low), bytearray(high), as_of).select("key", "value")

    def range_versions(self, low: bytes, high: bytes, deleted: bool = True) -> DataFrame:
        return reads.range_versions(self.versions(low, high), bytearray(low), bytearray(high), deleted)

    def snapshot(self, as_of: int | None = None, view: View | None = None) -> DataFrame:
        return reads.snapshot(self.versions(upto_ts=as_of, view=view), as_of)

    def history(self) -> DataFrame:
        return reads.history(merge.last_writer_wins(self.versions()))

    def runs(self) -> DataFrame:
        return self.manifest.frame(self.spark)

    def refresh(self) -> None:
        """See what other writers have published."""
        self._see(manifests.latest(self.files))

    # ------------------------------------------------------------ maintenance

    def compact(self) -> int:
        """Merge every full group of runs of a level into one run of the next,
        oldest first; returns the number of groups. Results of reads stay as they
        are. Old runs are kept for readers of old manifests until ``vacuum``."""
        done = 0
        while True:
            now = manifests.latest(self.files)
            plain = [{"level": r.level, "seq": r.seq, "run": r} for r in now.runs]
            groups = merge.compaction_groups(plain, self.config.fan_in, self.config.top_level)
            if not groups:
                self._see(now)
                return done
            group = [x["run"] for x in groups[0]]
            rows = read_runs(self.spark, self._paths(group))
            run = write_run(rows, self.files, self.config, max(r.level for r in group) + 1, max(r.seq for r in group))
            gone = {r.run_id for r in group}
            try:
                self._see(manifests.publish(self.files, now.next(runs=(*[r for r in now.runs if r.run_id not in gone], run))))
                done += 1
                self.log.info("compacted", runs=sorted(gone), into=run.run_id)
            except ManifestConflict:
                self.files.delete(run.path)

    def collect_garbage(self, horizon: int) -> None:
        """Rewrite all runs as one of the top level without the versions that no
        read at ``horizon`` or later sees. Earlier reads are no longer answered, but
        for those of transactions, which read the runs of their start.

        What was written since the oldest open transaction of this process began
        stays, so that its conflict test finds it. The manifest keeps the mark from
        which on all versions are there: a transaction of another process that began
        before the mark cannot be tested any more and aborts."""
        while True:
            now = manifests.latest(self.files)
            if not now.runs:
                return self._see(now)
            with self.lock:
                mark = min([now.next_seq, *(t.view.manifest.next_seq for t in self.open if t.state == "active")])
                held = any(len(t) for t in (*self.frozen, self.memory))
            rows = merge.last_writer_wins(read_runs(self.spark, self._paths(now.runs)))
            # a tombstone may go only if no older version can come back from elsewhere
            kept = merge.collect_garbage(rows, horizon, drop_tombstones=not held, keep_from=mark << SEQ_BITS)
            run = write_run(kept, self.files, self.config, self.config.top_level, max(r.seq for r in now.runs), merged=True)
            try:
                return self._see(manifests.publish(self.files, now.next(runs=(run,) if run else (), whole_from=max(now.whole_from, mark))))
            except ManifestConflict:
                if run:
                    self.files.delete(run.path)

    def vacuum(self, keep_manifests: int = 1, orphan_seconds: float = ORPHAN_SECONDS) -> list[str]:
        """Delete old manifests and the runs that only they name. Runs of open
        transactions of this process stay. A run that no manifest has named may be
        in the making by another writer, and goes once it is ``orphan_seconds`` old."""
        if keep_manifests < 1:
            raise StoreError("the latest manifest has to stay")
        found = manifests.numbers(self.files)
        of = {n: {r.run_id for r in manifests.Manifest.load(self.files.read(f"{manifests.FOLDER}/{n:012d}.json")).runs} for n in found}
        named = set().union(*(of[n] for n in found[-keep_manifests:]))
        with self.lock:
            named |= {r.run_id for t in self.open if t.state == "active" for r in t.view.manifest.runs}
        known, stored = set().union(*of.values()), self.files.names("runs")
        gone = [n for n in stored if n not in named and (n in known or time.time() - self.files.modified(f"runs/{n}") > orphan_seconds)]
        # runs go first: a vacuum that is cut off leaves manifests by which the next one knows them
        for n in gone:
            self.files.delete(f"runs/{n}")
        for n in found[:-keep_manifests]:
            if not of[n] & named - set().union(*(of[m] for m in found[-keep_manifests:])):
                self.files.delete(f"{manifests.FOLDER}/{n:012d}.json")
        return gone

    def metrics(self) -> dict[str, int]:
        """Numbers from the manifest and the memtable; ``live_keys`` is a query of its own."""
        view = self.view()
        runs, held = view.manifest.runs, sum(map(len, view.tables))
        return {
            "num_runs": len(runs), "memtable_keys": held, "memtable_bytes": sum(t.bytes for t in view.tables), "frozen_memtables": len(view.tables) - 1,
            "log_bytes": sum(x.size for t in view.tables for x in t.logs), "total_versions": sum(r.n_keys for r in runs) + held, "run_bytes": sum(r.bytes for r in runs), "disk_bytes": sum(r.file_bytes for r in runs),
            "manifest": view.manifest.number,
        }

    def live_keys(self) -> int:
        return self.snapshot().count()

    def begin(self):
        """A transaction on the snapshot of this moment."""
        from palimpsest.txn import Transaction

        return Transaction(self)
