"""Quality rules: a hashed n-gram log-likelihood ratio with base rules before it.

Two multinomials over hashed word unigrams and bigrams are counted over whole
texts: one of the trusted target (documents whose label says quality 1), one of
the raw corpus (all documents). A document's score is the mean over its n-grams
of log p_target - log p_raw, so it does not depend on length, and every
document is kept or dropped by one fixed threshold; nothing is drawn at random.

Counts are summed by bucket inside each task, then by Spark, so the driver gets
one row a bucket (a parameter) whatever the corpus is.

Defined results: a null or empty text has no words, fails the base rules and
scores 0; labels without id or value are ignored, of several labels of one id
the largest counts; repeated rows count as often as they are there; texts of any
length are read whole; with no label at all the target is uniform up to the raw
counts' smoothing; an empty table gives an empty one. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm._shared import materialize, texts
from palimpsest.operators import filters

#: Characters that count as symbols, and those that end words.
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
#: Longest text, in distinct words, whose three-word windows fit one 64-bit code.
ONE_CODE = 2_000_000

_MIX = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(29)


def word_ids(words: list[bytes]) -> tuple[np.ndarray, dict[bytes, int]]:
    """Ids in order of first occurrence, exact within a text."""
    seen: dict[bytes, int] = {}
    give = seen.setdefault
    return np.fromiter((give(w, len(seen)) for w in words), np.int64, len(words)), seen


def repeated_words(ids: np.ndarray, distinct: int) -> int:
    """Words inside three-word windows that occur twice or more, first ones included."""
    if len(ids) < 4:
        return 0
    pair = ids[:-1] * distinct + ids[1:]
    if distinct > ONE_CODE:
        pair = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        code = pair[:-1] * distinct + ids[2:]
    else:
        code = pair[:-1] * distinct + ids[2:]
    _, at, count = np.unique(code, return_inverse=True, return_counts=True)
    hit = count[at] > 1
    covered = np.zeros(len(ids), bool)
    for k in range(3):
        covered[k : k + len(hit)] |= hit
    return int(covered.sum())


def base_statistics(text: str, words: list[bytes], ids: np.ndarray, distinct: int) -> dict:
    lines = text.split("\n")
    worded = [x for x in lines if x.strip(SPACES)]
    return {
        "n_words": len(words),
        "word_chars": len(text) - sum(map(text.count, SPACES)),
        "n_symbols": sum(map(text.count, SYMBOLS)),
        "n_dup_lines": len(worded) - len(set(worded)),
        "n_repeat_words": repeated_words(ids, distinct),
    }


def ngram_buckets(ids: np.ndarray, seen: dict[bytes, int], bits: int) -> np.ndarray:
    """Buckets of a text's unigrams and bigrams, repeats included."""
    if not len(ids):
        return np.empty(0, np.int64)
    digest = xxhash.xxh3_64_intdigest
    one = np.fromiter(map(digest, seen), np.uint64, len(seen))[ids]
    two = (one[:-1] * _MIX) ^ (one[1:] + (one[1:] << _SHIFT))
    two = (two ^ (two >> _SHIFT)) * _MIX
    return (np.concatenate((one * _MIX, two)) >> np.uint64(64 - bits)).astype(np.int64)


COUNTS = pa.schema([("bucket", pa.int32()), ("raw", pa.int64()), ("target", pa.int64())])


def _count(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((2, 1 << bits), np.int64)
        held: list[list[np.ndarray]] = [[], []]
        waiting = 0

        def settle() -> None:
            nonlocal waiting
            for is_target, parts in enumerate(held):
                if parts:
                    got = np.bincount(np.concatenate(parts), minlength=1 << bits)
                    totals[0] += got
                    totals[1] += got * is_target
                    parts.clear()
            waiting = 0

        for batch in batches:
            trusted = batch.column("trusted").to_pylist()
            at = 0
            for part in texts(batch.column("text")):
                for t in part:
                    if t:
                        own = ngram_buckets(*word_ids(t.encode("utf-8", "surrogatepass").split()), bits)
                        held[bool(trusted[at])].append(own)
                        waiting += len(own)
                        if waiting > 1 << 22:
                            settle()
                    at += 1
        settle()
        own = np.flatnonzero(totals[0])
        if len(own):
            yield pa.record_batch([pa.array(own.astype(np.int32)), pa.array(totals[0][own]), pa.array(totals[1][own])], schema=COUNTS)

    return run


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        bits: int = 16, smoothing: float = 1.0, broadcast_ids: int = 1_000_000) -> np.ndarray:
    """Log-ratio of each bucket, float64 of 2^bits; one row a bucket comes back.

    Texts are counted where they are read. Up to ``broadcast_ids`` trusted ids are
    counted first and then sent to every task, which takes one scan and shuffles
    no text. More ids than that are met by a second scan, of which a Bloom filter of
    bounded size (see :mod:`palimpsest.operators.filters`) lets the trusted texts and
    few others go on to an exact join; the counts are the same."""
    good = labels.filter(F.col(f"`{label_col}`").isNotNull() & F.col(f"`{id_col}`").isNotNull())
    good = good.groupBy(F.col(f"`{id_col}`").alias("key")).agg(F.max(f"`{label_col}`").alias("q")).filter("q = 1").select("key")
    good = materialize(good, "quality-trusted")
    rows = docs.select(F.col(f"`{id_col}`").alias("key"), F.col(f"`{text_col}`").alias("text")).filter("text IS NOT NULL")
    count = lambda d: d.mapInArrow(_count(bits), "bucket int, raw long, target long")
    if good.count() <= broadcast_ids:
        trusted = F.broadcast(good.withColumnRenamed("key", "label_id"))
        found = count(rows.join(trusted, F.col("key") == F.col("label_id"), "left").select("text", F.col("label_id").isNotNull().alias("trusted")))
    else:
        found = count(rows.select("text", F.lit(False).alias("trusted")))
        own = count(filters.bloom_semi(rows, good).select("text", F.lit(True).alias("trusted")))
        found = found.unionByName(own.withColumn("raw", F.lit(0).cast("long")))
    sums = found.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.zeros(1 << bits), np.zeros(1 << bits)
    for bucket, r, t in sums.collect():  # 2^bits rows at most
        raw[bucket], target[bucket] = r, t
    prior = (raw + smoothing) / (raw.sum() + smoothing * len(raw))
    # the target backs off to the corpus, so words it has not shown count little against a text
    return np.log((target + smoothing * len(raw) * prior) / (target.sum() + smoothing * len(raw))) - np.log(prior)


FIELDS = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("score", pa.float64())]


def judge(text: Column, ratio: np.ndarray) -> Column:
    """Struct of the base statistics and the score of a whole text."""
    bits = int(len(ratio)).bit_length() - 1

    @F.arrow_udf("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double")
    def run(col: pa.Array) -> pa.Array:
        rows = []
        for part in texts(col):
            for t in part:
                t = t or ""
                words = t.encode("utf-8", "surrogatepass").split()
                ids, seen = word_ids(words)
                row = base_statistics(t, words, ids, len(seen))
                row["score"] = float(ratio[ngram_buckets(ids, seen, bits)].mean()) if words else 0.0
                rows.append(row)
        return pa.array(rows, pa.struct(FIELDS))

    return run.asNondeterministic()(text)


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = -0.1,
                  min_words: int = 50, max_repeat: int = 50, bits: int = 16) -> DataFrame:
    """(doc_id, base statistics, score, base_failed, kept) of every row of ``docs``."""
    ratio = fit(docs, labels, id_col, text_col, bits=bits)
    out = docs.select(F.col(f"`{id_col}`").alias("doc_id"), judge(F.col(f"`{text_col}`"), ratio).alias("x")).select("doc_id", "x.*")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= threshold))
