"""URL filters: host and path rules, then association rules mined from labels.

Spark's FP-growth mines combinations of URL tokens together with the label item
of labelled pages. A rule says that pages with all its tokens are to be blocked;
it is kept if enough blocked pages support it, its confidence (their share of all
labelled pages with these tokens) is high enough and no rule over some of its
tokens is kept already, which would block the same URLs and more. Rules have at
most ``max_len`` tokens. All counts are over whole token sets of all labelled
pages, and only rules that are kept come to the driver.

FP-growth itself has no bound on the length and finds 2^k sets among k tokens
that keep together. So tokens that are a rule alone leave first, and the others
are dealt to groups by rank: a basket is cut into one part for each choice of up to
``max_len`` of its groups, such that a part has at most ``WIDTH`` tokens, and items
carry their choice. A set of tokens counts in the parts of just the groups it is
from: every basket that has the set has one such part, so its counts stay exact.

Matching uses an inverted index: each mined rule is filed under its rarest token,
so a URL looks up only rules filed under tokens it has and then tests the rest.

Defined results: a null URL, or one without ``://``, has an empty host and path
and no tokens, so no rule fits and the verdict is allow; URLs of any length are
read whole, and all their tokens count; repeated URLs get equal verdicts; labels
without id or value are ignored, of several labels of one id a blocking one
counts; with no labels no rule is mined; an empty table gives an empty one.
Explicit rules come before mined ones.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from itertools import combinations

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm._shared import materialize, texts

#: Fixed rules of the contract: verdict, host, path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
BLOCK = "label=block"
_ASCII_LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_REST = r"(?s)^.*?://(.*)$"
TOKEN = r"[^A-Za-z0-9]+"


def host_column(url: Column) -> Column:
    rest = F.coalesce(F.regexp_extract(url, _REST, 1), F.lit(""))
    return F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), *_ASCII_LOWER)


def path_column(url: Column) -> Column:
    rest = F.coalesce(F.regexp_extract(url, _REST, 1), F.lit(""))
    return F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_columns(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest explicit rule that fits, or null.
    A rule fits its host and subdomains where the path starts with the rule's."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def tokens_column(host: Column, path: Column) -> Column:
    """Distinct URL tokens: words of host and path by place, without pure numbers,
    and the registered domain (last two labels) and top-level domain."""
    words = lambda c: F.filter(F.split(F.lower(c), TOKEN), lambda x: (F.length(x) > 0) & ~x.rlike("^[0-9]+$"))
    labels = F.split(host, r"\.")
    domain = F.when(F.size(labels) >= 2, F.concat_ws(".", F.element_at(labels, -2), F.element_at(labels, -1)))
    whole = F.array_compact(F.array(F.when(F.length(host) > 0, F.concat(F.lit("site:"), host)), F.concat(F.lit("domain:"), domain)))
    return F.array_distinct(F.concat(F.transform(words(host), lambda x: F.concat(F.lit("h:"), x)), F.transform(words(path), lambda x: F.concat(F.lit("p:"), x)), whole))


@dataclass(frozen=True)
class MinedRule:
    tokens: tuple[str, ...]
    confidence: float
    support: int

    @property
    def name(self) -> str:
        return " & ".join(self.tokens)


#: Most tokens of a part of a basket, among which FP-growth may find every set.
WIDTH = 12


def _parts(tokens: Column, rank: dict[str, int], groups: int, max_len: int) -> Column:
    """The parts of a basket (array of open tokens): one array a choice of up to
    ``max_len`` of the groups its tokens are in; an item is choice, group and token."""

    @F.arrow_udf("array<array<string>>")
    def run(col: pa.Array) -> pa.Array:
        out = []
        for own in col.to_pylist():
            by_group: dict[int, list[str]] = {}
            for t in own:
                by_group.setdefault(rank[t] % groups, []).append(t)
            here = []
            for pick in (p for k in range(1, max_len + 1) for p in combinations(sorted(by_group), k)):
                mark = ",".join(map(str, pick))
                here.append([f"{mark} {g} {t}" for g in pick for t in by_group[g]])
            out.append(here)
        return pa.array(out, pa.list_(pa.list_(pa.string())))

    return run.asNondeterministic()(tokens)


def _open(tokens: Column, rank: dict[str, int]) -> Column:
    """The tokens of a page that are in ``rank``, in its order."""

    @F.arrow_udf("array<string>")
    def run(col: pa.Array) -> pa.Array:
        return pa.array([sorted((t for t in own if t in rank), key=rank.__getitem__) for own in col.to_pylist()], pa.list_(pa.string()))

    return run.asNondeterministic()(tokens)


def _widest(tokens: Column, rank: dict[str, int], groups: int, max_len: int) -> Column:
    """Tokens of the widest part of a basket."""

    @F.arrow_udf("int")
    def run(col: pa.Array) -> pa.Array:
        sizes = [sorted(Counter(rank[t] % groups for t in own).values())[-max_len:] for own in col.to_pylist()]
        return pa.array([sum(x) for x in sizes], pa.int32())

    return run(tokens)


def mine(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url", label_id: str = "doc_id",
         blocked: Column | None = None, min_support: float = 0.002, min_count: int = 8, min_confidence: float = 0.7,
         max_len: int = 3) -> list[MinedRule]:
    """Mined rules, shortest first.

    A rule is supported by max(min_support * labelled pages, min_count) blocked
    pages or more. A blocked page with k tokens supports less than k^max_len rules, so
    there are less than k^max_len / min_support of them, however many pages there are."""
    blocked = blocked if blocked is not None else (F.col("quality") == 0) | (F.col("toxic") == 1)
    marked = labels.filter(F.col(label_id).isNotNull()).withColumn("bad", blocked).filter("bad IS NOT NULL")
    marked = marked.groupBy(F.col(label_id).alias("label_id")).agg(F.max(F.col("bad").cast("int")).alias("bad"))
    url = F.col(f"`{url_col}`")
    own = pages.select(F.col(f"`{id_col}`").alias("id"), tokens_column(host_column(url), path_column(url)).alias("tokens"))
    rows = materialize(own.join(marked, F.col("id") == F.col("label_id")).select("tokens", "bad"), "url-labelled")
    total, bad = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    floor = math.ceil(max(min_count, min_support * total))
    if not total or bad < floor:
        return []
    # tokens that enough blocked pages have: less than tokens a URL / min_support
    seen = rows.select(F.explode("tokens").alias("token"), "bad").groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("bad")).filter(F.col("bad") >= floor)
    single = {t: (n, b) for t, n, b in seen.collect()}
    rules = [MinedRule((t,), b / n, b) for t, (n, b) in sorted(single.items()) if b >= min_confidence * n]
    alone = {r.tokens[0] for r in rules}
    rank = {t: k for k, t in enumerate(sorted(single.keys() - alone, key=lambda t: (-single[t][1], t)))}
    if max_len < 2 or len(rank) < 2:
        return rules
    # no set with a token that is a rule is of use, nor are pages with less than two other tokens
    baskets = materialize(rows.select(_open(F.col("tokens"), rank).alias("items"), "bad").filter("size(items) > 1"), "url-baskets")
    if baskets.isEmpty():
        return rules
    groups = 1
    while groups < len(rank) and baskets.agg(F.max(_widest(F.col("items"), rank, groups, max_len))).first()[0] > WIDTH:
        groups = min(len(rank), max(max_len + 1, 2 * groups))
    parts = baskets.select(F.explode(_parts(F.col("items"), rank, groups, max_len)).alias("part"), "bad").filter("size(part) > 1")
    parts = materialize(parts.select(F.when(F.col("bad") == 1, F.concat("part", F.array(F.lit(BLOCK)))).otherwise(F.col("part")).alias("items")), "url-parts")
    n_parts = parts.count()
    if not n_parts:
        return rules
    sets = FPGrowth(itemsCol="items", minSupport=min(1.0, (floor - 0.5) / n_parts), minConfidence=0.0, numPartitions=max(8, parts.rdd.getNumPartitions())).fit(parts).freqItemsets
    # mark, group and token of each item but the label
    fields = sets.select("freq", F.array_contains("items", BLOCK).alias("with_label"), F.transform(F.filter("items", lambda x: x != BLOCK), lambda x: F.split(x, " ", 3)).alias("x"))
    of = lambda k: F.array_distinct(F.transform("x", lambda y: F.get(y, F.lit(k))))
    whole = (F.size("x").between(2, max_len)) & (F.size(of(1)) == F.size(F.split(F.get(of(0), F.lit(0)), ",")))
    counted = fields.filter(whole).select(F.array_sort(of(2)).alias("tokens"), "with_label", "freq")
    both = counted.groupBy("tokens").agg(F.max(F.when(F.col("with_label"), F.col("freq"))).alias("bad"), F.max(F.when(~F.col("with_label"), F.col("freq"))).alias("n"))
    passed = both.filter((F.col("bad") >= floor) & (F.col("bad") >= F.lit(min_confidence) * F.col("n")))
    passed = materialize(passed, "url-rules")
    # longer rules go where a shorter one is kept
    pairs = passed.filter("size(tokens) < %d" % max_len).select(F.col("tokens").alias("short"))
    longer = passed.select("tokens", F.explode(_subsets(F.col("tokens"), max_len)).alias("part"))
    covered = longer.join(pairs, F.col("part") == F.col("short"), "left_semi").select("tokens").distinct()
    kept = passed.join(covered, "tokens", "left_anti")
    return rules + [MinedRule(tuple(t), b / n, b) for t, b, n in sorted((tuple(r["tokens"]), r["bad"], r["n"]) for r in kept.collect())]


def _subsets(tokens: Column, max_len: int) -> Column:
    """All proper subsets of two tokens or more of a sorted array of at most ``max_len``."""
    picks = [p for k in range(2, max_len) for p in combinations(range(max_len), k)]
    if not picks:
        return F.array().cast("array<array<string>>")
    of = [F.when(F.size(tokens) > max(p[-1], len(p)), F.array(*[F.get(tokens, F.lit(i)) for i in p])) for p in picks]
    return F.array_compact(F.array(*of))


class Index:
    """Inverted index: each rule under its rarest token among the rules' tokens."""

    def __init__(self, rules: list[MinedRule]):
        self.rules, spread = rules, {}
        for r in rules:
            for t in r.tokens:
                spread[t] = spread.get(t, 0) + 1
        self.under: dict[str, list[int]] = {}
        for k, r in enumerate(rules):
            self.under.setdefault(min(r.tokens, key=lambda t: (spread[t], t)), []).append(k)

    def match(self, tokens: set[str]) -> list[int]:
        return sorted(k for t in tokens for k in self.under.get(t, ()) if tokens.issuperset(self.rules[k].tokens))

    def best(self, tokens: set[str]) -> int | None:
        """The rule of greatest confidence, then support, then name."""
        found = self.match(tokens)
        return min(found, key=lambda k: (-self.rules[k].confidence, -self.rules[k].support, self.rules[k].name), default=None)


def mined_column(tokens: Column, rules: list[MinedRule]) -> Column:
    """Name of the mined rule that blocks a token set, null if none does."""
    if not rules:
        return F.lit(None).cast("string")
    index = Index(rules)

    @F.arrow_udf("string")
    def run(col: pa.Array) -> pa.Array:
        out = []
        for part in texts(col):
            for t in part:
                k = index.best(set(t or ()))
                out.append(None if k is None else index.rules[k].name)
        return pa.array(out, pa.string())

    return run.asNondeterministic()(tokens)


def judge(pages: DataFrame, mined: list[MinedRule], id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, mined_rule) of every row of ``pages``."""
    url = F.col(f"`{url_col}`")
    out = pages.select(F.col(f"`{id_col}`").alias("page_id"), host_column(url).alias("host"), path_column(url).alias("path"))
    out = out.withColumn("fixed", rule_columns(F.col("host"), F.col("path"), rules))
    out = out.withColumn("mined_rule", mined_column(tokens_column(F.col("host"), F.col("path")), mined))
    own = F.when(F.col("mined_rule").isNotNull(), "block").otherwise("allow")
    return out.select("page_id", "host", "path", F.col("fixed.rule").alias("rule"), F.coalesce("fixed.verdict", own).alias("verdict"), "mined_rule")


def filter_urls(pages: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Mine and judge."""
    return judge(pages, mine(pages, labels, **options))
