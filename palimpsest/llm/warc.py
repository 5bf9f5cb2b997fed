"""WARC archives with a two-level capture index.

Writing: records of equal payloads meet by digest; one becomes the response and
the others revisits without payload. Each task streams gzip members into files
of its own and returns one capture row a record. The captures, sorted by
reversed-host URL key, go into compressed blocks, and a sparse directory keeps the
first key and the byte range of each block. A lookup bisects the first keys of
the index shards, then a shard's directory, reads one block's range, bisects its
lines and gets the byte range of the record.

Files have names of their own task attempt and are known only by what the
attempt returns, so a lost executor or a second attempt leaves at most files
that nothing points at. Paths are URIs of a folder that all executors share.

Defined results: a null payload is empty; a null URL has the empty key and no
target header; a null id sorts first and never becomes the response of a group
with ids; of rows with equal payload and the largest id all are responses (with
no ids at all, all rows of the group); an empty table gives an empty archive.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_left
from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm._shared import fresh_folder, materialize

#: Lines of a block, and bytes after which a task starts another archive file.
BLOCK_LINES, FILE_BYTES = 256, 512 << 20
#: Index rows a shard is planned for.
SHARD_ROWS = 2_000_000
#: Blocks and directories a reader keeps.
KEPT_BLOCKS, KEPT_DIRECTORIES = 64, 16
NO_ID = -(1 << 63)
RECORD_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
CONTROL = re.compile(r"[\x00-\x20\x7f]")

CAPTURE = "url_key string, page_id long, file string, offset long, length long"
CAPTURES = pa.schema([("url_key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


def url_key(url: str | None) -> str:
    """Reversed-host key: ``http://Blog.Example.com/x?y`` is ``com,example,blog)/x?y``."""
    if not url:
        return ""
    _, found, rest = url.partition("://")
    if not found:
        return ")" + CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url)
    host, path = re.match(r"(?s)([^/?#]*)(.*)", rest).groups()
    return ",".join(reversed(host.lower().split("."))) + ")" + CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", path)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(RECORD_SPACE, f'{page_id}/{digest}')}>"


def build_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record as a gzip member."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
    ]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if url is not None:
        head.append("WARC-Target-URI: " + CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-Id: {refers_to}"]
    else:
        block += payload
    head.append(f"Content-Length: {len(block)}")
    raw = "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def parse_record(member: bytes) -> tuple[dict[str, str], bytes]:
    """(headers in lower case, payload) of one gzip member."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
    size = int(headers["content-length"])
    if len(rest) < size:
        raise ValueError("the record is cut off")
    return headers, rest[:size].partition(b"\r\n\r\n")[2]


def _write_archives(folder: str, file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                for start in range(0, batch.num_rows, 256):
                    rows = []
                    for r in batch.slice(start, 256).to_pylist():
                        if out is None or at >= file_bytes:
                            if out is not None:
                                out.close()
                            name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                            out = store.open_output_stream(f"{root}/{name}", compression=None)
                        payload = (r["payload"] or "").encode("utf-8", "surrogatepass")
                        member = build_record(r["page_id"], r["url"], payload, payload_digest(payload), r["refers_to"], r["revisit"])
                        out.write(member)
                        rows.append({"url_key": url_key(r["url"]), "page_id": r["page_id"], "file": name, "offset": at, "length": len(member)})
                        at += len(member)
                    yield pa.RecordBatch.from_pylist(rows, CAPTURES)
        finally:
            if out is not None:
                out.close()

    return run


SHARDS = pa.schema([("first_key", pa.string()), ("first_id", pa.int64()), ("name", pa.string()), ("rows", pa.int64())])


def _write_index(folder: str, block_lines: int):
    """Blocks of sorted captures and their sparse directory; one shard a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        name, out, directory, lines, at, rows, first = uuid.uuid4().hex, None, [], [], 0, 0, None

        def put() -> None:
            nonlocal at, out
            if out is None:
                out = store.open_output_stream(f"{root}/{name}.blocks", compression=None)
            data = zlib.compress("\n".join("\t".join(map(str, x)) for x in lines).encode("utf-8", "surrogatepass"))
            out.write(data)
            directory.append((lines[0][0], lines[0][1], at, len(data)))
            at += len(data)
            lines.clear()

        for batch in batches:
            for r in batch.to_pylist():
                page_id = NO_ID if r["page_id"] is None else r["page_id"]
                first = first or (r["url_key"], page_id)
                lines.append((r["url_key"], page_id, r["file"], r["offset"], r["length"]))
                rows += 1
                if len(lines) >= block_lines:
                    put()
        if lines:
            put()
        if out is not None:
            out.close()
            with store.open_output_stream(f"{root}/{name}.directory", compression=None) as f:
                f.write(zlib.compress(json.dumps(directory).encode()))
            yield pa.RecordBatch.from_pylist([{"first_key": first[0], "first_id": first[1], "name": name, "rows": rows}], SHARDS)

    return run


class CaptureIndex:
    """Lookups in a written index. Keys order by URL key in code points, then id."""

    def __init__(self, folder: str, shards: list[tuple[str, int, str]]):
        self.folder = folder
        self.shards = sorted(shards)
        self.firsts = [s[:2] for s in self.shards]
        self.store = None
        self.kept: OrderedDict[tuple, object] = OrderedDict()

    def __getstate__(self):
        return {"folder": self.folder, "shards": self.shards, "firsts": self.firsts, "store": None, "kept": OrderedDict()}

    def _keep(self, key: tuple, make, most: int):
        if key in self.kept:
            self.kept.move_to_end(key)
            return self.kept[key]
        value = self.kept[key] = make()
        while len(self.kept) > most:
            self.kept.popitem(last=False)
        return value

    def _open(self):
        if self.store is None:
            self.store, self.root = pafs.FileSystem.from_uri(self.folder)
        return self.store

    def _directory(self, name: str) -> list[tuple]:
        def read():
            with self._open().open_input_stream(f"{self.root}/{name}.directory", compression=None) as f:
                return [tuple(x) for x in json.loads(zlib.decompress(f.read()))]

        return self._keep((name,), read, KEPT_BLOCKS + KEPT_DIRECTORIES)

    def _block(self, name: str, offset: int, length: int) -> list[tuple]:
        def read():
            with self._open().open_input_file(f"{self.root}/{name}.blocks") as f:
                f.seek(offset)
                lines = zlib.decompress(f.read(length)).decode("utf-8", "surrogatepass").split("\n")
            return [(a, int(b), c, int(d), int(e)) for a, b, c, d, e in (x.split("\t") for x in lines)]

        return self._keep((name, offset), read, KEPT_BLOCKS + KEPT_DIRECTORIES)

    def lookup(self, key: str, page_id: int | None = None, any_id: bool = False) -> list[tuple]:
        """Captures (url_key, id, file, offset, length) of a key and id, or of all ids."""
        low = (key, NO_ID if any_id or page_id is None else page_id)
        high = (key, (1 << 63) - 1) if any_id else low
        self._open()
        out = []
        shard = max(bisect_left(self.firsts, low) - 1, 0)
        while shard < len(self.shards) and self.firsts[shard] <= high:
            name = self.shards[shard][2]
            directory = self._directory(name)
            heads = [d[:2] for d in directory] if len(directory) < 64 else directory
            block = max(bisect_left(heads, low if heads is not directory else (*low, -1)) - 1, 0)
            while block < len(directory) and directory[block][:2] <= high:
                lines = self._block(name, *directory[block][2:])
                at = bisect_left(lines, low)
                while at < len(lines) and lines[at][:2] <= high:
                    out.append(lines[at])
                    at += 1
                block += 1
            shard += 1
        return out


class Archive:
    """A written archive: its folder, its index and the number of records."""

    def __init__(self, spark: SparkSession, folder: str, index: CaptureIndex, records: int):
        self.spark, self.folder, self.index, self.records = spark, folder, index, records

    def lookup(self, probes: DataFrame) -> DataFrame:
        """Captures of probes (url_key, page_id): probes are dealt by key range, so
        a task reads each block of its range once."""
        index = self.index

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys, ids = batch.column("url_key").to_pylist(), batch.column("page_id").to_pylist()
                found = [x for k, i in zip(keys, ids) for x in index.lookup(k, i)]
                cols = list(zip(*found)) if found else [()] * 5
                cols[1] = [None if i == NO_ID else i for i in cols[1]]
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, CAPTURES)], schema=CAPTURES)

        dealt = probes.select("url_key", "page_id").distinct().repartitionByRange("url_key", "page_id").sortWithinPartitions("url_key", "page_id")
        return dealt.mapInArrow(run, CAPTURE)

    def read(self, captures: DataFrame) -> DataFrame:
        """Records of captures by range reads, in order of place within a file."""
        folder = self.folder

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            store, root = pafs.FileSystem.from_uri(folder)
            name, f = None, None
            for batch in batches:
                for start in range(0, batch.num_rows, 256):
                    rows = []
                    for c in batch.slice(start, 256).to_pylist():
                        if c["file"] != name:
                            if f is not None:
                                f.close()
                            name, f = c["file"], store.open_input_file(f"{root}/{c['file']}")
                        f.seek(c["offset"])
                        rows.append(_row(*parse_record(f.read(c["length"]))))
                    yield pa.RecordBatch.from_pylist(rows, RECORDS)
            if f is not None:
                f.close()

        # a file is dealt in stretches of 64 MB, so that one large file is not one task
        dealt = captures.withColumn("stretch", F.shiftright("offset", 26)).repartition("file", "stretch").sortWithinPartitions("file", "offset")
        return dealt.select("file", "offset", "length").mapInArrow(run, "page_id long, url string, record_type string, payload_digest string, refers_to long, payload binary")


RECORDS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def _row(headers: dict[str, str], payload: bytes) -> dict:
    revisit = headers["warc-type"] == "revisit"
    stated = headers["warc-payload-digest"].removeprefix("sha1:")
    if not revisit and payload_digest(payload) != stated:
        raise ValueError(f"payload of {headers['warc-record-id']} does not have its digest")
    number = lambda k: int(headers[k]) if k in headers else None
    return {"page_id": number("x-page-id"), "url": headers.get("warc-target-uri"), "record_type": headers["warc-type"], "payload_digest": stated, "refers_to": number("x-refers-to-page-id"), "payload": None if revisit else payload}


def write(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
          min_revisit_bytes: int = 0, file_bytes: int = FILE_BYTES, block_lines: int = BLOCK_LINES) -> Archive:
    """Write ``pages`` as WARC files with an index."""
    spark = pages.sparkSession
    folder = folder or fresh_folder(spark, "warc")
    store, root = pafs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    own = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.coalesce(F.col(f"`{payload_col}`"), F.lit("")).alias("payload"))
    own = own.withColumn("sha", F.unhex(F.sha1(F.col("payload").cast("binary"))))
    # the largest id of each payload: sums in the map, one row a payload after it
    most = own.groupBy(F.col("sha").alias("of")).agg(F.max("page_id").alias("refers_to"))
    rows = own.join(most, F.col("sha") == F.col("of"))
    revisit = ~F.col("page_id").eqNullSafe(F.col("refers_to")) & (F.octet_length("payload") >= min_revisit_bytes)
    rows = rows.select("page_id", "url", "payload", revisit.alias("revisit"), F.when(revisit, F.col("refers_to")).alias("refers_to"))
    captures = materialize(rows.mapInArrow(_write_archives(folder, file_bytes), CAPTURE), "warc-captures")
    records = captures.count()
    shards = max(1, min(captures.rdd.getNumPartitions(), -(-records // SHARD_ROWS) * 8))
    # ranges over key and id split the captures of one URL too
    dealt = captures.repartitionByRange(shards, "url_key", "page_id").sortWithinPartitions("url_key", "page_id", "file", "offset")
    made = materialize(dealt.mapInArrow(_write_index(folder, block_lines), "first_key string, first_id long, name string, rows long"), "warc-shards")
    # one row a shard of SHARD_ROWS / 8 captures or more
    index = CaptureIndex(folder, [(r["first_key"], r["first_id"], r["name"]) for r in made.collect()])
    return Archive(spark, folder, index, records)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every
    page, read back from a written archive through its index. A revisit takes the
    size from the response that it refers to."""
    archive = write(pages, **options)
    id_col, url_col = options.get("id_col", "page_id"), options.get("url_col", "url")
    probes = pages.select(url_key_column(F.col(f"`{url_col}`")).alias("url_key"), F.col(f"`{id_col}`").cast("long").alias("page_id"))
    captures = materialize(archive.lookup(probes), "warc-found")
    read = archive.read(captures).withColumn("payload_bytes", F.octet_length("payload").cast("long")).drop("payload", "url")
    read = materialize(read, "warc-read")
    sizes = read.filter("record_type = 'response'").groupBy(F.col("payload_digest").alias("of")).agg(F.max("payload_bytes").alias("bytes"))
    revisits = read.filter("record_type = 'revisit'").join(sizes, F.col("payload_digest") == F.col("of"), "left")
    out = read.filter("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return out.unionByName(revisits.select("page_id", F.col("bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to"))


def url_key_column(url):
    @F.arrow_udf("string")
    def run(col: pa.Array) -> pa.Array:
        return pa.array([url_key(u) for u in col.to_pylist()], pa.string())

    return run.asNondeterministic()(url)
