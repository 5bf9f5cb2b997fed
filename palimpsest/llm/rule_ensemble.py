"""Quality classifier: a sparse ensemble of rules over text statistics.

Boosted shallow regression trees are grown on statistics of labelled texts;
every path from a root to a node becomes a conjunctive rule; a lasso logistic
regression over rule indicators sets most weights to zero; and the rules that
remain are compiled into one Spark column expression over the statistics, so
scoring runs in generated code. Statistics read whole texts.

Fitting collects the statistics of at most ``max_rows`` labelled ids (those of
the smallest hash of their id, a documented bound); all documents are scored.

Defined results: null and empty texts have all statistics 0 and get the score
that these give; labels without id or value are ignored, of several labels of
one id the mean counts, 1 from a half; with no labels, or labels of one kind,
the score is their smoothed share; an empty table gives an empty one. Statistics
never see labels, language, source or ids.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm._shared import held, materialize, texts
from palimpsest.llm.quality import SPACES, repeated_words, word_ids

UPPER, LOWER, DIGIT = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58))
MARKS = bytes([*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)])
SYMBOL = b"#*$%&|<>{}[]\\^~_=+@"

STATISTICS = (
    "log_words", "mean_word", "sd_word", "longest_word", "upper_share", "lower_share", "digit_share", "mark_share",
    "symbol_share", "high_share", "pipe_share", "bang_share", "marked_words", "short_words", "distinct_share",
    "top_share", "top5_share", "repeat_share", "stutter_share", "dup_line_share", "log_lines", "mean_line", "stop_share", "capital_words",
)


def statistics(text: str) -> tuple[float, ...]:
    """STATISTICS of a whole text, in their order."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return (0.0,) * len(STATISTICS)
    ids, seen = word_ids(words)
    n, size = len(words), len(raw)
    lens = np.fromiter(map(len, seen), np.float64, len(seen))[ids]
    counts = np.bincount(ids)
    top = np.sort(counts)[::-1]
    heads = np.frombuffer(b"".join([w[:1] for w in seen]), np.uint8)[ids]
    tails = np.frombuffer(b"".join([w[-1:] for w in seen]), np.uint8)[ids]
    chars = float(lens.sum())
    without = lambda table: size - len(raw.translate(None, table))
    upper, lower, digit, mark, symbol = map(without, (UPPER, LOWER, DIGIT, MARKS, SYMBOL))
    alpha = ((tails >= 97) & (tails <= 122)) | ((tails >= 65) & (tails <= 90)) | (tails >= 128)
    worded = [x for x in text.split("\n") if x.strip(SPACES)]
    plain = alpha | (tails == 46) | (tails == 44)
    return (
        float(np.log1p(n)), chars / n, float(lens.std()), float(lens.max()), upper / chars, lower / chars, digit / chars, mark / chars,
        symbol / chars, (chars - upper - lower - digit - mark) / chars, raw.count(b"|") / n, raw.count(b"!") / n, float((~plain).mean()), float((lens <= 2).mean()), len(seen) / n,
        float(top[0]) / n, float(top[:5].sum()) / n, repeated_words(ids, len(seen)) / n, float((ids[1:] == ids[:-1]).sum()) / n,
        (len(worded) - len(set(worded))) / len(worded), float(np.log1p(len(worded))), n / len(worded), float((tails == 46).mean()), float(((heads >= 65) & (heads <= 90)).mean()),
    )


def statistics_column(text: Column) -> Column:
    """Struct of STATISTICS of a text column."""

    @F.arrow_udf(", ".join(f"{s} double" for s in STATISTICS))
    def run(col: pa.Array) -> pa.Array:
        held("statistics")
        rows = [statistics(t or "") for part in texts(col) for t in part]
        table = np.array(rows, np.float64).reshape(len(rows), len(STATISTICS))
        return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(table[:, i])) for i in range(len(STATISTICS))], names=list(STATISTICS))

    return run.asNondeterministic()(text)


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, upper bound?, threshold): x <= t, else x > t."""

    terms: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for k, below, t in self.terms:
            out &= (x[:, k] <= t) if below else (x[:, k] > t)
        return out

    def column(self, struct: str) -> Column:
        out = F.lit(True)
        for k, below, t in self.terms:
            c = F.col(f"{struct}.{STATISTICS[k]}")
            out = out & (c <= F.lit(t) if below else c > F.lit(t))
        return out


@dataclass
class RuleModel:
    intercept: float
    rules: list[Rule] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for r, w in zip(self.rules, self.weights):
            z += w * r.holds(x)
        return 1 / (1 + np.exp(-z))

    def column(self, struct: str) -> Column:
        """The model as one expression over a struct of statistics."""
        z = F.lit(float(self.intercept))
        for r, w in zip(self.rules, self.weights):
            z = z + F.when(r.column(struct), F.lit(float(w))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def _grow(x: np.ndarray, codes: np.ndarray, edges: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, depth: int, least: int) -> list[tuple[tuple, np.ndarray, float]]:
    """Nodes of one regression tree: (terms, rows, value); leaves last of each path."""
    nodes, todo = [], [((), np.arange(len(x)), 0)]
    while todo:
        terms, rows, level = todo.pop()
        g, h = grad[rows], hess[rows]
        value = g.sum() / (h.sum() + 1.0)
        best = (1e-6, None)
        if level < depth and len(rows) >= 2 * least:
            base = g.sum() ** 2 / (h.sum() + 1.0)
            for k, cuts in enumerate(edges):
                if not len(cuts):
                    continue
                c = codes[rows, k]
                gs, hs, ns = (np.cumsum(np.bincount(c, w, len(cuts) + 1))[:-1] for w in (g, h, np.ones(len(rows))))
                ok = (ns >= least) & (len(rows) - ns >= least)
                gain = np.where(ok, gs**2 / (hs + 1.0) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1.0) - base, 0.0)
                j = int(gain.argmax())
                if gain[j] > best[0]:
                    best = (float(gain[j]), (k, j))
        leaf = best[1] is None
        if terms:
            nodes.append((terms, rows if leaf else None, value))
        elif leaf:
            nodes.append(((), rows, value))
        if not leaf:
            k, j = best[1]
            left = codes[rows, k] <= j
            cut = float(edges[k][j])
            todo += [((*terms, (k, False, cut)), rows[~left], level + 1), ((*terms, (k, True, cut)), rows[left], level + 1)]
    return nodes


def _simple(terms: tuple) -> tuple:
    """One bound a statistic and side, in fixed order."""
    bounds: dict[tuple[int, bool], float] = {}
    for k, below, t in terms:
        old = bounds.get((k, below))
        bounds[k, below] = t if old is None else (min if below else max)(old, t)
    return tuple((k, below, t) for (k, below), t in sorted(bounds.items()))


def extract_rules(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 48, least: int = 5) -> list[Rule]:
    """Distinct rules of the paths of boosted trees."""
    edges = []
    for k in range(x.shape[1]):
        values = np.unique(x[:, k])
        mids = (values[1:] + values[:-1]) / 2
        edges.append(mids if len(mids) <= bins else np.unique(np.quantile(mids, np.linspace(0, 1, bins))))
    codes = np.stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(edges)], 1)
    z, rules = np.full(len(y), np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        for terms, rows, value in _grow(x, codes, edges, y - p, p * (1 - p), depth, least):
            if rows is not None:
                z[rows] += rate * np.clip(value, -4, 4)
            if terms:
                rules.setdefault(_simple(terms))
    return [Rule(t) for t in rules]


def fit_rules(x: np.ndarray, y: np.ndarray, penalty: float = 2e-3, steps: int = 600, **grow) -> RuleModel:
    """Extract rules and weigh them by lasso logistic regression (FISTA)."""
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 1.0) / (len(y) + 2.0)
        return RuleModel(float(np.log(share / (1 - share))))
    rules = extract_rules(x, y, **grow)
    a = np.stack([r.holds(x) for r in rules], 1).astype(np.float64)
    # of rules that hold for the same rows the first, shortest one stays
    order = sorted(range(len(rules)), key=lambda j: len(rules[j].terms))
    first: dict[bytes, int] = {}
    for j in order:
        first.setdefault(np.packbits(a[:, j] > 0).tobytes(), j)
    pick = sorted(first.values())
    rules, a = [rules[j] for j in pick], a[:, pick]
    mean = a.mean(0)
    spread = np.sqrt(mean * (1 - mean)) + 1e-3
    s = (a - mean) / spread
    w = np.zeros(s.shape[1])
    v, b, t = w.copy(), float(np.log(y.mean() / (1 - y.mean()))), 1.0
    bound = np.linalg.norm(s.T @ s / len(y), 2) * 0.25 + 1e-9
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(s @ v + b)))
        b -= 2.0 * float((p - y).mean())
        new = v - (s.T @ (p - y)) / len(y) / bound
        new = np.sign(new) * np.maximum(np.abs(new) - penalty / bound, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / t2 * (new - w), new, t2
    keep = np.flatnonzero(np.abs(w) > 1e-6)
    weights = w[keep] / spread[keep]
    return RuleModel(float(b - (weights * mean[keep]).sum()), [rules[j] for j in keep], weights.tolist())


def labelled_statistics(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
                        max_rows: int = 20_000, only: Column | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of at most ``max_rows`` labelled ids, in a fixed order."""
    ids = F.col("label_id")
    marked = labels.select(F.col(f"`{id_col}`").alias("label_id"), F.col(f"`{label_col}`").cast("double").alias("y")).filter("label_id IS NOT NULL AND y IS NOT NULL")
    if only is not None:
        marked = marked.filter(only)
    marked = marked.groupBy("label_id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    # the bound: a top-k of ids, so what is broadcast has max_rows rows at most
    marked = materialize(marked.orderBy(F.xxhash64(ids), ids).limit(max_rows), "rule-labels")
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).join(F.broadcast(marked), F.col("doc_id") == ids)
    rows = rows.select("doc_id", "y", statistics_column(F.col("text")).alias("s"))
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("y", "s")).alias("x")).select("doc_id", "x.y", "x.s.*")
    got = sorted(rows.toPandas().itertuples(index=False, name=None))
    table = np.array(got, np.float64).reshape(len(got), 2 + len(STATISTICS))
    return table[:, 2:], table[:, 1]


def not_held_out(ids: Column) -> Column:
    """Whether a label may be learned from: crc32 of the id as text, mod 4, is not 2."""
    return F.crc32(F.encode(ids.cast("string"), "UTF-8")) % 4 != 2


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = 20_000, **options) -> RuleModel:
    x, y = labelled_statistics(docs, labels, id_col, text_col, max_rows=max_rows, only=not_held_out(F.col("label_id")))
    return fit_rules(x, y, **options)


def score_documents(docs: DataFrame, model: RuleModel, text_col: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text in column ``into``."""
    from palimpsest.llm._shared import fresh_name

    s = fresh_name([*docs.columns, into], "statistics")
    out = docs.withColumn(s, statistics_column(F.col(f"`{text_col}`"))).withColumn(into, model.column(s))
    return out.drop(s)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7, **options) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``."""
    model = fit(docs, labels, id_col, text_col, **options)
    own = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    held = F.coalesce(~not_held_out(F.col("doc_id")), F.lit(False))
    return score_documents(own, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
