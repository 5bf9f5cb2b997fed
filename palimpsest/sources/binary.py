"""Import and export of binary run files and logs.

Fixed formats, all integers little-endian:

run file: for each entry u16 length and value; then for each entry u16 length,
encoded key, u32 place of its value; then the u32 place of each of those index
records; then filter words of 8 bytes; then a footer of 16 bytes: u16 level, u16
number, u32 entries, u32 start of the index, u32 start of the filter.

log: u16 key length, u16 value length, encoded key, value.

A value of one zero byte is a tombstone. The filter is that of
:class:`palimpsest.functions.bloom.RunFilter` over the keys."""

from __future__ import annotations

import struct
from bisect import bisect_right
from collections.abc import Iterable, Iterator

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from palimpsest.functions.bloom import Bitmap, RunFilter
from palimpsest.functions.codec import decode_key_bytes, encode_key_bytes
from palimpsest.model import FormatError

TOMBSTONE = b"\x00"
FOOTER = struct.Struct("<HHIII")
MOST = 0xFFFF
SCHEMA = "key binary, commit_ts bigint, seq bigint, value binary, is_deleted boolean"

#: (key, commit_ts, value or None for a tombstone)
Entry = tuple[bytes, int, bytes | None]


def _checked(key: bytes, value: bytes | None) -> bytes:
    value = TOMBSTONE if value is None else value
    if len(key) > MOST or len(value) > MOST:
        raise FormatError(f"keys and values of this format have {MOST} bytes at most")
    return value


def dump_run(entries: Iterable[Entry], level: int = 0, number: int = 0) -> bytes:
    """A run file of entries, which are sorted first."""
    entries = sorted(entries, key=lambda e: e[:2])
    data, places = bytearray(), []
    for key, _, value in entries:
        value = _checked(key + bytes(8), value)
        places.append(len(data))
        data += struct.pack("<H", len(value)) + value
    start, index = len(data), []
    for (key, ts, _), place in zip(entries, places):
        index.append(len(data))
        encoded = encode_key_bytes(key, ts)
        data += struct.pack("<H", len(encoded)) + encoded + struct.pack("<I", place)
    data += struct.pack(f"<{len(index)}I", *index)
    filter_at = len(data)
    members = RunFilter(max(1, len(entries)))
    for key in {e[0] for e in entries}:
        members.add(key)
    data += members.bitmap.to_bytes()
    if len(data) >= 1 << 32:
        raise FormatError("a run file of this format ends before 4 GiB")
    return bytes(data) + FOOTER.pack(level, number, len(entries), start, filter_at)


def footer(data: bytes) -> dict[str, int]:
    if len(data) < FOOTER.size:
        raise FormatError("a run file has a footer of 16 bytes")
    return dict(zip(("level", "number", "n_keys", "index_at", "filter_at"), FOOTER.unpack(data[-FOOTER.size :])))


def load_run(data: bytes) -> Iterator[Entry]:
    """Entries of a run file in index order."""
    f = footer(data)
    at = f["index_at"]
    for _ in range(f["n_keys"]):
        try:
            (n,) = struct.unpack_from("<H", data, at)
            encoded = data[at + 2 : at + 2 + n]
            (place,) = struct.unpack_from("<I", data, at + 2 + n)
            (size,) = struct.unpack_from("<H", data, place)
        except struct.error as e:
            raise FormatError("the index is cut off") from e
        value = data[place + 2 : place + 2 + size]
        if len(encoded) < n or len(value) < size or place >= f["index_at"]:
            raise FormatError("an index entry points outside the data")
        yield (*decode_key_bytes(encoded), None if value == TOMBSTONE else value)
        at += 2 + n + 4


class RunFile:
    """Lookups in a run file, in any file system, without reading it whole: the
    footer and the filter once, then a bisection over the index."""

    def __init__(self, uri: str):
        store, name = pafs.FileSystem.from_uri(uri)
        self.file = store.open_input_file(name)
        size = self.file.size()
        if size < FOOTER.size:
            raise FormatError("a run file has a footer of 16 bytes")
        self.about = footer(self.file.read_at(FOOTER.size, size - FOOTER.size))
        self.n, at = self.about["n_keys"], self.about["filter_at"]
        self.records = at - 4 * self.n
        if not self.about["index_at"] <= self.records <= at <= size - FOOTER.size:
            raise FormatError("the footer points outside the file")
        words = self.file.read_at(size - FOOTER.size - at, at)
        self.members = RunFilter(max(1, self.n), Bitmap.from_bytes(words)) if words else None

    def __enter__(self) -> RunFile:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()

    def _record(self, i: int) -> tuple[tuple[bytes, int], int]:
        """((key, time), place of the value) of an index record."""
        (at,) = struct.unpack("<I", self.file.read_at(4, self.records + 4 * i))
        (n,) = struct.unpack("<H", self.file.read_at(2, at))
        body = self.file.read_at(n + 4, at + 2)
        return decode_key_bytes(body[:n]), struct.unpack("<I", body[n:])[0]

    def ends(self) -> tuple[bytes, bytes] | None:
        """First and last key."""
        return (self._record(0)[0][0], self._record(self.n - 1)[0][0]) if self.n else None

    def get(self, key: bytes, as_of: int) -> Entry | None:
        """The newest entry of a key at a time, tombstones included; None if there
        is none, which the filter says for most keys that the file lacks."""
        if not self.n or (self.members is not None and key not in self.members):
            return None
        i = bisect_right(range(self.n), (key, as_of), key=lambda k: self._record(k)[0]) - 1
        if i < 0:
            return None
        (found, ts), place = self._record(i)
        if found != key:
            return None
        (size,) = struct.unpack("<H", self.file.read_at(2, place))
        value = self.file.read_at(size, place + 2)
        return found, ts, None if value == TOMBSTONE else value


def dump_log_entry(key: bytes, ts: int, value: bytes | None) -> bytes:
    encoded = encode_key_bytes(key, ts)
    value = _checked(encoded, value)
    return struct.pack("<HH", len(encoded), len(value)) + encoded + value


def load_log(data: bytes, strict: bool = True) -> Iterator[Entry]:
    """Entries of a log in the order of writing. A log that ends inside an entry
    is an error, or with ``strict=False`` (recovery after a crash) ends before it."""
    at = 0
    while at < len(data):
        head = data[at : at + 4]
        k, v = struct.unpack("<HH", head) if len(head) == 4 else (0, 0)
        if len(head) < 4 or at + 4 + k + v > len(data):
            if strict:
                raise FormatError("the log ends inside an entry")
            return
        encoded, value = data[at + 4 : at + 4 + k], data[at + 4 + k : at + 4 + k + v]
        yield (*decode_key_bytes(encoded), None if value == TOMBSTONE else value)
        at += 4 + k + v


class _File(InputPartition):
    def __init__(self, store_uri: str, number: int):
        super().__init__(store_uri)
        self.number = number


class _Reader(DataSourceReader):
    def __init__(self, path: str, load, suffixes: tuple[str, ...]):
        self.path, self.load, self.suffixes = path, load, suffixes

    def partitions(self):
        store, root = pafs.FileSystem.from_uri(self.path)
        info = store.get_file_info(root)
        found = [info] if info.type == pafs.FileType.File else store.get_file_info(pafs.FileSelector(root))
        names = sorted(f.path for f in found if f.type == pafs.FileType.File and f.path.endswith(self.suffixes))
        scheme = self.path.split("://")[0] + "://" if "://" in self.path else ""
        return [_File(scheme + n, i) for i, n in enumerate(names)] or [_File("", 0)]

    def read(self, partition):
        if not partition.value:
            return
        store, name = pafs.FileSystem.from_uri(partition.value)
        with store.open_input_stream(name, compression=None) as f:
            data = f.read()
        for i, (key, ts, value) in enumerate(self.load(data)):
            yield (key, ts, (partition.number << 32) + i, value, value is None)


class RunFiles(DataSource):
    """``spark.read.format("kv_run").load(path)``: a task a file."""

    @classmethod
    def name(cls):
        return "kv_run"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options["path"], load_run, (".sst",))


class LogFiles(DataSource):
    """``spark.read.format("kv_log").load(path)``: entries in order of writing by
    seq; of one key and time the last counts once versions are merged."""

    @classmethod
    def name(cls):
        return "kv_log"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options["path"], load_log, (".log", ".log.imm"))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RunFiles)
    spark.dataSource.register(LogFiles)


def export_runs(versions: DataFrame, folder: str, level: int = 0, file_bytes: int = 64 << 20, tasks: int | None = None) -> DataFrame:
    """Write versions as run files in a shared folder, each a sorted range of
    keys of at most ``file_bytes`` (a longer entry is a file of its own); returns
    (name, n_keys). Task i of n names its files i, n + i, 2n + i and so on, so no
    two share a name and a second attempt writes the same files."""
    tasks = tasks or int(versions.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        store, root = pafs.FileSystem.from_uri(folder)
        number, held, size = TaskContext.get().partitionId(), [], 0

        def put():
            nonlocal number, size
            name = f"{level}_{number}.sst"
            own = f"{root}/{name}.{TaskContext.get().taskAttemptId()}.tmp"
            with store.open_output_stream(own, compression=None) as f:
                f.write(dump_run(held, level, number & MOST))
            store.move(own, f"{root}/{name}")
            out = pa.RecordBatch.from_pylist([{"name": name, "n_keys": len(held)}], pa.schema([("name", pa.string()), ("n_keys", pa.int64())]))
            held.clear()
            number, size = number + tasks, 0
            return out

        for batch in batches:
            for r in batch.to_pylist():
                value = None if r["is_deleted"] else r["value"]
                n = len(r["key"]) + len(value or b"") + 24
                if held and size + n > file_bytes:
                    yield put()
                held.append((r["key"], r["commit_ts"], value))
                size += n
        if held:
            yield put()

    rows = versions.select("key", "commit_ts", "value", "is_deleted").repartitionByRange(tasks, "key", "commit_ts").sortWithinPartitions("key", "commit_ts")
    return rows.mapInArrow(run, "name string, n_keys bigint")


def export_log(versions: DataFrame, folder: str, tasks: int | None = None) -> DataFrame:
    """Write versions as log files in the order of their seq, a file a task;
    returns (name, n_entries). Files are read back in the order of their names."""
    tasks = tasks or int(versions.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        store, root = pafs.FileSystem.from_uri(folder)
        name, n = f"{TaskContext.get().partitionId():08d}.log", 0
        own = f"{root}/{name}.{TaskContext.get().taskAttemptId()}.tmp"
        with store.open_output_stream(own, compression=None) as f:
            for batch in batches:
                for r in batch.to_pylist():
                    f.write(dump_log_entry(r["key"], r["commit_ts"], None if r["is_deleted"] else r["value"]))
                    n += 1
        store.move(own, f"{root}/{name}")
        yield pa.RecordBatch.from_pylist([{"name": name, "n_entries": n}], pa.schema([("name", pa.string()), ("n_entries", pa.int64())]))

    rows = versions.select("key", "commit_ts", "seq", "value", "is_deleted").repartitionByRange(tasks, "seq").sortWithinPartitions("seq")
    return rows.mapInArrow(run, "name string, n_entries bigint")


def look_up(names: DataFrame, folder: str, keys: list[bytes], as_of: int) -> DataFrame:
    """Entries of run files (name) that reads of a few keys at a time find, as
    (key, commit_ts, value, is_deleted): one a file and key at most. A task opens
    a file at a time and reads only what the lookups touch."""

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("key", pa.binary()), ("commit_ts", pa.int64()), ("value", pa.binary()), ("is_deleted", pa.bool_())])
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with RunFile(f"{folder}/{name}") as f:
                    found = [e for k in keys if (e := f.get(k, as_of))]
                yield pa.RecordBatch.from_pylist([{"key": k, "commit_ts": ts, "value": v, "is_deleted": v is None} for k, ts, v in found], schema)

    return names.select("name").mapInArrow(run, "key binary, commit_ts bigint, value binary, is_deleted boolean")


def as_versions(rows: DataFrame) -> DataFrame:
    """Rows of these sources with the newest of each (key, commit_ts)."""
    from palimpsest.operators.merge import last_writer_wins

    return last_writer_wins(rows.select("key", "commit_ts", "seq", "value", F.col("is_deleted")))
