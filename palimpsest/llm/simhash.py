"""SimHash near-duplicates, found with covering locality-sensitive hashing.

A table's bit mask keeps those of the 64 positions i with <m(i), v> = 1 over
GF(2), where m maps positions to vectors of radius + 1 bits and v runs over the
2^(radius+1) - 1 nonzero vectors. For any set of at most ``radius`` differing
positions some v is orthogonal to all of their m(i), so each pair within the
radius agrees under some mask: no pair is missed, for any choice of m.

Only distinct fingerprints enter the tables. Rows with the same masked value are
dealt to one task and sorted there; a run of up to ``bucket_rows`` fingerprints
is linked by a breadth-first search that compares a fingerprint with those not
reached yet and returns the links of a spanning forest, never all pairs. A
longer run is returned whole instead and enters the tables of a second family,
restricted to that bucket: there two masks leave at most ``FREE_BITS`` bits free,
which bounds a run whatever the corpus is. Components are then joined by repeated min-label steps over distinct
links, each step written to the shared folder.

Defined results: a null or empty text has no words and the fingerprint zero,
which links like any other; repeated rows are equal nodes; a null id is a row
whose component is the smallest id of its component, null only if no id there
is known; an empty table gives an empty one. Extra input columns are ignored
by ``components`` and kept by ``deduplicate``.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.llm._shared import fresh_name, held, materialize, texts

BITS = 64
#: Most bits that a mask of the first and one of the second family leave free.
FREE_BITS = 22
#: Distinct fingerprints of a bucket that one search links. Those of a bucket above
#: it enter the second family: a row of each of its 31 masks, for each first mask
#: under which it lies in so large a bucket.
BUCKET_ROWS = 32_768
#: Parts of a group that meets by its key.
SALTS = 64
#: Shingles whose bits are counted at a time: 64 MB of bytes.
CHUNK = 1 << 16
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """Unsigned fingerprint of a whole text (see the module's contract)."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > width:
        starts, ends = starts[: len(words) - width + 1], ends[width - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts.tolist(), ends.tolist())), np.uint64, len(starts))
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = np.ascontiguousarray(hashes[at : at + CHUNK].astype(">u8")).view(np.uint8)
        ones += np.unpackbits(part).reshape(-1, BITS).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprint_column(text: Column, width: int = 4, seed: int = 42) -> Column:
    """Fingerprint of a text column as a (signed) long."""

    @F.arrow_udf("long")
    def run(col: pa.Array) -> pa.Array:
        held("fingerprints")
        found = [fingerprint(t, width, seed) for part in texts(col) for t in part]
        return pa.array(np.array(found, np.uint64).view(np.int64))

    return run.asNondeterministic()(text)


def covering_masks(radius: int, salt: int = 0) -> list[int]:
    """Masks of one covering family, as signed longs. Positions get the nonzero
    vectors in turn, in an order that the salt sets, so masks keep near half of the bits."""
    size = radius + 1
    turn = [1 + i % ((1 << size) - 1) for i in range(BITS)]
    random.Random(f"covering-{radius}-{salt}").shuffle(turn)
    masks = []
    for v in range(1, 1 << size):
        mask = sum(1 << i for i, m in enumerate(turn) if (m & v).bit_count() % 2)
        masks.append(mask - (1 << BITS) if mask >> (BITS - 1) else mask)
    return masks


def spanning_links(values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of the graph of pairs within the radius."""
    rest, a, b = values.astype(np.uint64), [], []
    while len(rest):
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            at = todo.pop()
            near = np.bitwise_count(rest ^ at) <= radius
            if near.any():
                found = rest[near]
                rest = rest[~near]
                a.append(np.full(len(found), at, np.uint64))
                b.append(found)
                todo.extend(found)
    if not a:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    return np.concatenate(a), np.concatenate(b)


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("path", pa.string())])


def _link_runs(radius: int, bucket_rows: int):
    """Over rows (path, key, fp) sorted by path and key: links, or the rows of
    a long run with b null. At most bucket_rows fingerprints of a run are held."""

    def flush(path: str, held: list[np.ndarray], out: list) -> None:
        values = np.concatenate(held) if len(held) > 1 else held[0]
        if len(values) > 1:
            a, b = spanning_links(values.view(np.uint64), radius)
            if len(a):
                out.append(pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.nulls(len(a), pa.string())], schema=LINKS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, count, long = None, [], 0, False
        for batch in batches:
            if not batch.num_rows:
                continue
            paths, keys = batch.column("path"), batch.column("key").to_numpy(zero_copy_only=False)
            fps = batch.column("fp").to_numpy(zero_copy_only=False)
            codes = paths.dictionary_encode()
            names, code = codes.dictionary.to_pylist(), codes.indices.to_numpy(zero_copy_only=False)
            change = np.flatnonzero((keys[1:] != keys[:-1]) | (code[1:] != code[:-1])) + 1
            edges = np.concatenate(([0], change, [len(keys)]))
            out: list[pa.RecordBatch] = []
            # runs of one row inside a batch can have no link
            for i in np.flatnonzero((np.diff(edges) > 1) | (np.arange(len(edges) - 1) == 0) | (np.arange(len(edges) - 1) == len(edges) - 2)):
                lo, hi = edges[i], edges[i + 1]
                own = (names[code[lo]], int(keys[lo]))
                if own != at:
                    if held and not long:
                        flush(at[0], held, out)
                    at, held, count, long = own, [], 0, False
                held.append(fps[lo:hi])
                count += int(hi - lo)
                long |= count > bucket_rows
                if long:
                    rows = np.concatenate(held)
                    held = []
                    name = f"{own[0]}/{own[1]:x}"
                    out.append(pa.record_batch([pa.array(rows), pa.nulls(len(rows), pa.int64()), pa.array([name] * len(rows))], schema=LINKS))
            yield from out
        out = []
        if held and not long:
            flush(at[0], held, out)
        yield from out

    return run


def links(prints: DataFrame, radius: int = 4, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Distinct links (a, b) between the distinct fingerprints of ``prints`` (fp
    long) whose components are those of all pairs within the radius."""
    todo, found = prints.select("fp", F.lit("").alias("path")), None
    for level, most in enumerate((bucket_rows, 1 << FREE_BITS)):
        masks = covering_masks(radius, level)
        keys = F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])
        rows = todo.select("fp", "path", F.posexplode(keys).alias("table", "key"))
        rows = rows.select(F.concat_ws(":", "path", F.col("table").cast("string")).alias("path"), "key", "fp")
        dealt = rows.repartition("path", "key").sortWithinPartitions("path", "key")
        made = materialize(dealt.mapInArrow(_link_runs(radius, most), "a long, b long, path string"), "simhash-links")
        new = made.filter("b IS NOT NULL").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        found = new if found is None else found.unionByName(new)
        todo = made.filter("b IS NULL").select(F.col("a").alias("fp"), "path")
        if todo.isEmpty():
            break
    else:
        raise AssertionError("two masks leave at most FREE_BITS bits free, so no bucket of the second family is longer")
    return materialize(found.distinct(), "simhash-links")


def join_components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, root) for each node of edges (a, b), root its component's smallest.

    Alternates large-star and small-star steps: aggregations with partial sums
    and salted joins, so a star with a third of all edges stays spread. The
    number of steps grows with the log of the longest path."""
    edges = edges.filter(F.col("a") != F.col("b")).select("a", "b")
    last = None
    while True:
        # large-star: each larger neighbour of u is linked to the least of u's neighbourhood
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = least_of_group(both, "a", "b", "b", "m").filter("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        large = materialize(large.filter("a <> b").distinct(), label)
        # small-star: u and its smaller neighbours are linked to the least of them
        small = least_of_group(large, "a", "b", "b", "m").select(F.explode(F.array(*[F.struct(F.col(c).alias("a"), F.col("m").alias("b")) for c in "ab"])).alias("x"))
        small = small.select("x.a", "x.b").filter("a <> b").distinct()
        edges = materialize(small, label)
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.countDistinct("a")).first()
        if state == last or state[0] == 0:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        last = state


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4,
               bucket_rows: int = BUCKET_ROWS, width: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``docs``."""
    own = docs.select(F.col(f"`{id_col}`").alias("doc_id"), fingerprint_column(F.col(f"`{text_col}`"), width).alias("fp"))
    own = materialize(own, "simhash-prints")
    return label_components(own, radius, bucket_rows).select("doc_id", "fp", "component_id")


def _spread(rows: DataFrame, by: Column) -> DataFrame:
    """``rows`` with a column ``salt`` that cuts each group of them in SALTS."""
    return rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))


def least_of_group(rows: DataFrame, group: str, by: str, value: str, into: str) -> DataFrame:
    """Each row of ``rows`` with the least ``value`` of its group, found and handed
    back by (group, salt): a group of any size is SALTS rows where it meets as a whole."""
    own = _spread(rows, F.col(by))
    part = own.groupBy(group, "salt").agg(F.min(value).alias("part"))
    whole = part.groupBy(F.col(group).alias("of")).agg(F.min("part").alias(into))
    back = part.join(whole, F.col(group) == F.col("of")).select("of", F.col("salt").alias("of_salt"), into)
    return own.join(back, (F.col(group) == F.col("of")) & (F.col("salt") == F.col("of_salt"))).drop("of", "of_salt", "salt")


def label_components(own: DataFrame, radius: int = 4, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """component_id, the smallest doc_id reachable, and root, a fingerprint that
    names the component, for rows (doc_id, fp, ...). Rows of one fingerprint and
    fingerprints of one component may be a third of all: both meet salted."""
    own = _spread(own, F.col("doc_id"))
    pairs = materialize(own.groupBy("fp", "salt").agg(F.min("doc_id").alias("least")), "simhash-pairs")
    nodes = materialize(pairs.groupBy("fp").agg(F.min("least").alias("least")), "simhash-nodes")
    roots = join_components(links(nodes.select("fp"), radius, bucket_rows), "simhash-components")
    linked = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    linked = materialize(linked, "simhash-linked")
    named = materialize(least_of_group(linked, "root", "fp", "least", "component_id"), "simhash-roots")
    named = pairs.select("fp", "salt").join(named.select(F.col("fp").alias("of"), "component_id", "root"), F.col("fp") == F.col("of"))
    named = named.select("of", F.col("salt").alias("of_salt"), "component_id", "root")
    return own.join(named, (F.col("fp") == F.col("of")) & (F.col("salt") == F.col("of_salt"))).drop("of", "of_salt", "salt")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4,
                bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The rows of ``docs`` with one of each component: that of the smallest id.
    Of rows with that id and several fingerprints the least one stays, of
    repeated rows one; rows without an id stay only where their component has no
    id, one of them. Texts are read twice and shuffled once."""
    ids, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    slim = docs.select(ids.alias("doc_id"), fingerprint_column(text).alias("fp"), F.xxhash64(text).alias("h"))
    slim = materialize(slim, "simhash-prints")
    named = label_components(slim.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), radius, bucket_rows)
    # of a component, the fingerprint that holds its smallest id; the least one among ties
    best = named.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "fp")).alias("x"))
    best = best.select(F.col("x.doc_id").alias("keep_id"), F.col("x.fp").alias("keep_fp"))
    held = slim.join(best, F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("fp") == F.col("keep_fp")))
    held = held.groupBy("keep_id", "fp").agg(F.min("h").alias("keep_h"), F.count(F.lit(1)).alias("rows"))
    held = materialize(held.select("keep_id", "keep_h", "rows"), "simhash-kept")
    names = {c: fresh_name(docs.columns, c) for c in ("keep_id", "keep_h")}
    same = ids.eqNullSafe(F.col(names["keep_id"])) & (F.xxhash64(text) == F.col(names["keep_h"]))

    def rows_of(kept: DataFrame) -> DataFrame:
        # dealt in one way at every size: the kept ids grow with the documents
        side = kept.select(*[F.col(c).alias(n) for c, n in names.items()]).hint("shuffle_hash")
        return docs.join(side, same)

    once = rows_of(held.filter("rows = 1")).select(*[F.col(f"`{c}`") for c in docs.columns])
    if held.filter("rows > 1").isEmpty():
        return once
    nth = fresh_name([*docs.columns, *names.values()], "nth")
    one = Window.partitionBy(names["keep_id"], names["keep_h"]).orderBy(F.lit(1))
    more = rows_of(held.filter("rows > 1")).withColumn(nth, F.row_number().over(one)).filter(f"{nth} = 1")
    return once.unionByName(more.select(*[F.col(f"`{c}`") for c in docs.columns]))
