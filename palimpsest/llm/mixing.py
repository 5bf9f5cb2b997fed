"""Mixing sources to target weights with hash-threshold histograms.

Every row gets a 64-bit hash; a source's rows are taken in hash order until its
budget is reached, but nothing is ever sorted. Sizes are summed by source and
hash bucket, a running sum over the fixed number of buckets finds the bucket in
which the budget ends, and only that bucket is refined by the next bits of the
hash. A few levels leave single rows. The result is a threshold per source and
the mix is a filter. A larger budget has a larger threshold, so the mixes of
growing budgets are nested. DataFrame functions only.

Defined results: a null text has size 0 and takes nothing; a null source is a
source of its own, last in order; an empty table gives an empty one; the hash
covers id and text, so copies under other ids are told apart, and rows that are
equal in id, text and source are told apart only as a count (they are
interchangeable); texts of any length are counted whole. Extra input columns are
kept, and added columns replace those of the same name.

Bounds: targets are found in windows that see one row a source, in one task, and
a histogram has 4,096 rows a source; rows that repeat at the very cut of a source,
where some but not all of them are taken, are numbered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.llm._shared import WORD_PATTERN, fresh_name, materialize

#: Bits of the hash that one level resolves: 4,096 buckets a source.
LEVEL_BITS = 12
#: Levels before rows themselves are compared; 36 bits part rows up to 6e10 a source.
LEVELS = 3


def word_count(text: Column) -> Column:
    """Number of words of WORD_PATTERN, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)).cast("long"), F.lit(0).cast("long"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """Target of each source from (source, source_size), one row a source.

    Sources in code point order, null last, weigh ``weights`` in turn and share
    the sum of all sizes. A target stops at ``cap`` times its source's size and
    the excess is shared again by weight: the fixed point gives min(w * level,
    cap * size), and as sources reach their cap in the order of cap * size / w,
    one running sum over that order finds the level. The windows see a row a
    source and no documents."""
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    s = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (turn + 1).cast("int")))
    s = s.withColumn("most", F.col("source_size") * F.lit(float(cap)))
    by_cap = Window.orderBy(F.col("most") / F.col("w"), F.col("source").isNull(), "source")
    all_rows = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("total", F.sum("source_size").over(all_rows).cast("double"))
    s = s.withColumn("w_left", F.sum("w").over(all_rows) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    s = s.withColumn("left", F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
    # the first source in this order that keeps below its cap fixes the level
    here = F.col("left") / F.col("w_left")
    s = s.withColumn("level", F.first(F.when(here * F.col("w") <= F.col("most"), here), ignorenulls=True).over(by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.when(F.col("level").isNull(), F.col("most")).otherwise(F.least(F.col("most"), F.col("w") * F.col("level")))
    return s.select("source", "source_size", target.alias("target"))


def _bucket(level: int) -> Column:
    return F.shiftrightunsigned("h", 64 - LEVEL_BITS * (level + 1)).bitwiseAND(F.lit((1 << LEVEL_BITS) - 1))


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def plan_mix(rows: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """(source, source_size, target, passes, cut, ties, n) from rows (source, size, h).

    A source is taken whole ``passes`` times and once more for hashes under
    ``cut``; of the n rows whose hash equals ``cut``, ``ties`` are taken once more."""
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = targets(sums, weights, cap)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = plan.withColumn("passes", whole).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    plan = materialize(plan.withColumn("prefix", F.lit(0).cast("long")), "mix-plan")
    open_rows = rows
    for level in range(LEVELS):
        budget = plan.select(F.col("source").alias("s"), "rest", "prefix")
        shift = 64 - LEVEL_BITS * level
        if level:
            # only the rows of the boundary buckets go on: a table of its own, one in 2^LEVEL_BITS of the rows before
            inside = _same(F.col("source"), F.col("s")) & (F.col("rest") > 0) & (F.shiftrightunsigned("h", shift) == F.col("prefix"))
            open_rows = materialize(open_rows.join(budget, inside).select("source", "size", "h"), "mix-open")
        counted = open_rows.withColumn("b", _bucket(level))
        # each task sums by (source, bucket) before the shuffle
        bins = counted.groupBy("source", "b").agg(F.sum("size").alias("size"))
        running = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
        bins = bins.withColumn("upto", F.sum("size").over(running)).withColumnRenamed("source", "bs")
        found = bins.join(plan.select(F.col("source").alias("s"), "rest"), _same(F.col("bs"), F.col("s")))
        found = found.filter(F.col("upto") >= F.col("rest")).groupBy("bs").agg(F.min(F.struct("b", "upto", "size")).alias("x"))
        found = found.select("bs", F.col("x.b").alias("b"), (F.col("x.upto") - F.col("x.size")).alias("before"))
        # rounding may leave a rest just above the sum of a last bucket: then all is taken
        last = F.lit((1 << LEVEL_BITS) - 1).cast("long")
        plan = plan.join(found, _same(F.col("source"), F.col("bs")), "left").select(
            "source", "source_size", "target", "passes",
            (F.col("rest") - F.coalesce(F.col("before"), F.lit(0))).alias("rest"),
            (F.shiftleft("prefix", LEVEL_BITS) + F.coalesce(F.col("b"), last)).alias("prefix"),
        )
        plan = materialize(plan, "mix-plan")
    # what is left: the rows of one bucket of 2^-36 of the hash range a source
    budget = plan.select(F.col("source").alias("s"), "rest", "prefix")
    inside = _same(F.col("source"), F.col("s")) & (F.col("rest") > 0) & (F.shiftrightunsigned("h", 64 - LEVEL_BITS * LEVELS) == F.col("prefix"))
    left = open_rows.join(budget, inside).groupBy("source", "rest", "h").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    running = Window.partitionBy("source").orderBy("h").rowsBetween(Window.unboundedPreceding, 0)
    left = left.withColumn("before", F.sum("size").over(running) - F.col("size")).filter((F.col("before") < F.col("rest")) & (F.col("size") > 0))
    # the last hash under the budget: as many of its equal rows as come nearest
    ends = left.groupBy("source").agg(F.max(F.struct("h", "before", "size", "n", "rest")).alias("x"))
    take = F.round((F.col("x.rest") - F.col("x.before")) / (F.col("x.size") / F.col("x.n"))).cast("long")
    ends = ends.select(F.col("source").alias("s"), F.col("x.h").alias("cut"), F.least(take, F.col("x.n")).alias("ties"), F.col("x.n").alias("n"))
    lowest = F.shiftleft("prefix", 64 - LEVEL_BITS * LEVELS)
    # without a row at the end, all whole buckets before it are taken; a rest of 0 takes none
    return plan.join(ends, _same(F.col("source"), F.col("s")), "left").select(
        "source", "source_size", "target", "passes",
        F.when(F.col("rest") > 0, F.coalesce(F.col("cut"), lowest)).otherwise(F.lit(0)).cast("long").alias("cut"),
        F.coalesce(F.col("ties"), F.lit(0).cast("long")).alias("ties"), F.coalesce(F.col("n"), F.lit(0).cast("long")).alias("n"),
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0, keep: list[str] | None = None) -> DataFrame:
    """All rows of ``docs`` with size, source_size, target, copies and taken, and
    the columns ``keep`` (all, if not given).

    ``copies`` is how often the mix repeats a row, ``taken`` is copies * size.
    Where the text is not kept, it is read once: what is left of a row is written."""
    added = ("size", "source_size", "target", "copies", "taken")
    keep = [c for c in docs.columns if (keep is None or c in keep) and (c.lower() not in added or c in (id_col, text_col, source_col))]
    kept = {c: fresh_name([*docs.columns, *added, "source", "h", "s", "cut", "ties", "n", "passes", "nth"], f"c{i}_") for i, c in enumerate(keep)}
    base = docs.select(
        *[F.col(f"`{c}`").alias(kept[c]) for c in keep],
        F.col(f"`{source_col}`").cast("string").alias("source"),
        word_count(F.col(f"`{text_col}`")).alias("size"),
        F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).alias("h"),
    )
    if text_col not in keep:
        base = materialize(base, "mix-rows")
        rows = base.select("source", "size", "h")
    else:
        rows = materialize(base.select("source", "size", "h"), "mix-rows")
    plan = materialize(plan_mix(rows, weights, cap).withColumnRenamed("source", "s"), "mix-plan")
    # unsigned order of the hash is signed order with the top bit turned
    turn = F.lit(-(1 << 63))
    under = F.col("h").bitwiseXOR(turn) < F.col("cut").bitwiseXOR(turn)
    joined = base.join(plan, _same(F.col("source"), F.col("s")), "left")
    tied = F.coalesce((F.col("h") == F.col("cut")) & (F.col("ties") > 0), F.lit(False))
    extra = under | (tied & (F.col("ties") == F.col("n")))
    out = joined
    # the hash at the cut has one row in general; repeated rows are numbered only
    # where some, but not all, of them are taken
    if not plan.filter("ties > 0 AND ties < n").isEmpty():
        some = tied & (F.col("ties") < F.col("n"))
        numbered = joined.filter(some).withColumn("nth", F.row_number().over(Window.partitionBy("source", "h").orderBy("size")))
        out = joined.filter(~some).withColumn("nth", F.lit(None).cast("int")).unionByName(numbered)
        extra = extra | F.coalesce(F.col("nth") <= F.col("ties"), F.lit(False))
    copies = F.when(F.col("size") > 0, F.col("passes") + extra.cast("long")).otherwise(F.lit(0)).cast("long")
    return out.select(
        *[F.col(kept[c]).alias(c) for c in keep], "size", "source_size", "target",
        copies.alias("copies"), (copies * F.col("size")).alias("taken"),
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken, with the columns of ``docs``."""
    out = mix(docs, **options)
    return out.filter("copies > 0").withColumn("copies", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*docs.columns)
