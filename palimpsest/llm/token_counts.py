"""Token counts at every prefix, for truncation and budgets without re-encoding.

A byte-pair vocabulary with word ends cuts a text into words and encodes each
alone, so a prefix of a text costs the tokens of its whole words plus those of
the word it cuts. The counts up to each word are one running sum per text, and
those inside a word come from the dynamic program of
:mod:`palimpsest.llm.bpe`, which finds the count of every prefix of a word, cut
there, in one pass over the links of an Aho-Corasick automaton; its last entry is
the word's own count. Words repeat, so both are kept in bounded memos.

Prefixes are those of the text as it is given, in code points, whatever its
normal form does to their number: the text is cut where its normal form is that
of its parts, and a prefix that ends inside such a part is counted from the last
word before it. Special strings count as one token, and as plain text where a
prefix cuts them.

Defined results: a null or empty text has no tokens; special strings inside a
text count as one token each, as the library has it; words and texts of any
length are counted whole, in time linear in them; a limit under 0 is 0; repeated
rows get equal results; an empty table gives an empty one.
"""

from __future__ import annotations

import json
import re
import unicodedata
from bisect import bisect_left, bisect_right

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm._shared import held, texts
from palimpsest.llm.bpe import Memo, Merges, prefix_counts


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies:
    printable Latin-1 bytes stand for themselves, others count up from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in own else next(rest)) for b in range(256)]


#: Planes that hold letters; code points above are in no class.
CLASSED = range(0x80, 0x40000)


def ranges(points: list[int]) -> str:
    """Code points in order as the inside of a regex set."""
    spans: list[list[int]] = []
    for c in points:
        if spans and spans[-1][1] == c - 1:
            spans[-1][1] = c
        else:
            spans.append([c, c])
    return "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in spans)


def unicode_classes(path: str) -> tuple[str, str, dict[int, str], frozenset[str]]:
    """Sets of letters and numbers as the library has them, lower-case forms that
    Python lacks, and the set of code points in question. Unicode tables differ by version in code points that
    Python's table leaves unassigned; for those the library itself is asked."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    split, normal = t.pre_tokenizer.pre_tokenize_str, t.normalizer.normalize_str
    asked = [c for c in CLASSED if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) == "Cn"]
    classed = [c for c in asked if len(split(f"!{chr(c)}")) > 1]
    letters = [c for c in classed if len(split(f"a{chr(c)}")) == 1]
    numbers = sorted(set(classed) - set(letters))
    lower = {c: low for c in asked if (low := normal(chr(c))) != chr(c)}
    unsure = ranges(asked)
    sets = [rf"[[\p{{{k}}}--[{unsure}]]" + (f"||[{ranges(own)}]]" if own else "]") for k, own in (("L", letters), ("N", numbers))]
    return *sets, lower, frozenset(map(chr, asked))


def is_latin(text: str) -> bool:
    """Whether all code points are below 256."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
        return True
    except UnicodeEncodeError:
        return False


class Counter:
    """Counts of a word-end byte-pair tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, steps = spec["model"], spec["normalizer"]["normalizers"]
        if model["type"] != "BPE" or not model.get("end_of_word_suffix") or model.get("byte_fallback"):
            raise ValueError("a byte-level BPE file with word ends is asked for")
        if [s["type"] for s in steps] != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("unknown normalisation")
        self.end = model["end_of_word_suffix"]
        self.special = [t["content"] for t in spec["added_tokens"] if t["special"] and not t["normalized"]]
        self.split_special = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        if pattern != r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+":
            raise ValueError("unknown words")
        letters, numbers, self.lower, self.unsure = unicode_classes(path)
        # three forms of one pattern, by what a text holds: Latin-1 spelled out, the
        # regex module's classes, and the sets that tell apart what versions class differently
        own = lambda p: "".join(re.escape(c) for c in map(chr, range(256)) if regex.match(p, c))
        self.latin_words = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{own(r'\p{L}')}]+|[{own(r'\p{N}')}]|[^{own(r'[\s\p{L}\p{N}]')}]+")
        self.plain_words = regex.compile(pattern)
        self.exact_words = regex.compile(f"'s|'t|'re|'ve|'m|'ll|'d|{letters}+|{numbers}|[[^\\s]--{letters}--{numbers}]+", regex.V1)
        vocab = model["vocab"]
        letter = byte_letters()
        self.to_letters = {b: letter[b] for b in range(256)}
        # one letter more for the word end, so that an automaton can read it as part of the last symbol
        symbols = [""] * (max(vocab.values()) + 1)
        for piece, i in vocab.items():
            symbols[i] = piece
        pairs = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            pairs[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.merges = Merges(symbols, pairs)
        usable = {i for i in range(len(symbols)) if self.merges.rank[i] >= 0}
        base = {vocab[x] for b in letter for x in (b, b + self.end) if x in vocab}
        self.pieces = {p: i for p, i in vocab.items() if i in usable or i in base}
        stems: dict[str, list[int]] = {}
        for p, i in self.pieces.items():
            closing = p.endswith(self.end)
            stems.setdefault(p.removesuffix(self.end), [-1, -1])[closing] = i
        self.auto = ahocorasick.Automaton()
        for p, (inside, closing) in stems.items():
            if p:
                self.auto.add_word(p, (len(p), inside, closing))
        self.auto.make_automaton()
        self.letters = letter
        self.memo = Memo(self._count, longest=64)
        self.tables = Memo(self._table, 20_000, longest=64)

    def _spell(self, word: str) -> str:
        if word.isascii():
            return word  # printable ASCII letters stand for themselves
        return "".join(map(self.letters.__getitem__, word.encode("utf-8", "surrogatepass")))

    def _program(self, word: str) -> list[int]:
        """Tokens of each prefix of a word's bytes, cut there, by the one-pass program."""
        return prefix_counts(self.auto, self.merges, self._spell(word))

    def _count(self, word: str) -> int:
        count = self._program(word)[-1]
        return count if count > 0 else len(self._merged(word))

    def _merged(self, word: str) -> list[int]:
        """The definition: merge symbols by rank."""
        spelled = [self.letters[b] for b in word.encode("utf-8", "surrogatepass")]
        spelled[-1] += self.end
        return self.merges.encode_by_merging([self.pieces[s] for s in spelled])

    def _table(self, word: str) -> tuple[int, ...]:
        """Tokens of each prefix of a word, cut there: entry k is for k characters."""
        if word[0] == "'" and len(word) > 1 and word[1].isalpha():
            # a cut contraction is two words
            return tuple(sum(map(self.memo, self._cut(word[:k]))) for k in range(len(word) + 1))
        found = self._program(word)
        if not word.isascii():
            ends = np.cumsum([0, *(len(c.encode("utf-8", "surrogatepass")) for c in word)]).tolist()
            found = [found[e] for e in ends]
        return tuple(n if n >= 0 else len(self._merged(word[:k])) for k, n in enumerate(found))

    def pattern(self, normal: str):
        """The fastest form of the word pattern that is exact for a text."""
        if is_latin(normal):
            return self.latin_words
        return self.plain_words if self.unsure.isdisjoint(normal) else self.exact_words

    def _cut(self, normal: str) -> list[str]:
        return self.pattern(normal).findall(normal)

    def normal(self, text: str) -> str:
        """Normal form up to white space, of which only the place matters."""
        if text.isascii():
            return text.lower()
        text = unicodedata.normalize("NFC", text)
        if not is_latin(text) and not self.unsure.isdisjoint(text):
            text = text.translate(self.lower)
        # lower-casing is done a character at a time: no final sigma by context
        return "".join(map(str.lower, text)) if "Σ" in text else text.lower()

    def count(self, text: str | None) -> int:
        """Tokens of a whole text."""
        if not text:
            return 0
        total = 0
        if self.split_special and any(map(text.__contains__, self.special)):
            parts = self.split_special.split(text)
            total += len(parts) - 1
        else:
            parts = [text]
        for part in parts:
            words = self._cut(self.normal(part))
            found = list(map(self.memo.young.get, words))
            if None in found:
                memo = self.memo
                found = [memo(word) if n is None else n for word, n in zip(words, found)]
            total += sum(found)
        return total

    def prefixes(self, text: str | None) -> PrefixCounts:
        return PrefixCounts(self, text or "")


def blocks_of(text: str) -> list[str]:
    """A text cut where its composed form is that of its parts put together: before
    a code point that does not combine with what comes before it."""
    starts, compose = [0], unicodedata.normalize
    for i, c in enumerate(text):
        if i and not c.isascii():
            before = "" if unicodedata.combining(c) else text[starts[-1] : i]
            if not before or compose("NFC", before + c) != compose("NFC", before) + compose("NFC", c):
                continue
        if i:
            starts.append(i)
    return [text[a:b] for a, b in zip(starts, [*starts[1:], len(text)])]


class Stretch:
    """A part of a text without special strings: its normal form, the words of
    that with their running counts, and the way from prefixes to normal prefixes."""

    def __init__(self, counter: Counter, text: str, start: int):
        self.counter, self.text, self.start = counter, text, start
        self.normal = counter.normal(text)
        self.ends: list[int] | None = None  # None: as many characters as in the text
        if not text.isascii() and (len(self.normal) != len(text) or not unicodedata.is_normalized("NFC", text)):
            blocks = blocks_of(text)
            forms = list(map(counter.normal, blocks))
            if "".join(forms) != self.normal:
                raise AssertionError("the normal form is not that of its blocks")
            self.ends = np.cumsum([0, *map(len, blocks)]).tolist()
            self.normal_ends = np.cumsum([0, *map(len, forms)]).tolist()
        self._words()

    def _words(self) -> None:
        found = list(self.counter.pattern(self.normal).finditer(self.normal))
        self.starts = [m.start() for m in found]
        self.words = [m.group() for m in found]
        self.upto = np.concatenate(([0], np.cumsum([self.counter.memo(w) for w in self.words], dtype=np.int64))).tolist()

    def _of_normal(self, n: int) -> int:
        """Tokens of the first n characters of the normal form."""
        at = bisect_right(self.starts, n - 1) - 1 if n > 0 else -1
        if at < 0:
            return 0
        inside = min(n - self.starts[at], len(self.words[at]))
        return self.upto[at] + (self.counter.tables(self.words[at])[inside] if inside < len(self.words[at]) else self.upto[at + 1] - self.upto[at])

    def with_tail(self, n: int, tail: str) -> int:
        """Tokens of the first n characters of the normal form and a string after
        them: only the last word before it is cut anew."""
        at = bisect_right(self.starts, n - 1) - 1 if n > 0 else -1
        start, before = (self.starts[at], self.upto[at]) if at >= 0 else (0, 0)
        return before + sum(map(self.counter.memo, self.counter._cut(self.normal[start:n] + tail)))

    def count(self, k: int) -> int:
        """Tokens of the first k characters."""
        if self.ends is None:
            return self._of_normal(k)
        at = bisect_right(self.ends, k) - 1
        rest = self.text[self.ends[at] : k]
        n = self.normal_ends[at]
        return self.with_tail(n, self.counter.normal(rest)) if rest else self._of_normal(n)

    def most(self, limit: int) -> int:
        """Most characters within the limit: the first word that does not fit whole
        bounds the search, which goes back from its end."""
        at = bisect_right(self.upto, limit) - 1
        if at >= len(self.words):
            return len(self.text)
        n = self.starts[at] + len(self.words[at])
        if self.ends is None:
            k = n
        else:
            k = self.ends[bisect_left(self.normal_ends, n)]
        while k > 0 and self.count(k) > limit:
            k -= 1
        return k

    def table(self) -> np.ndarray:
        """Counts of all prefixes, the empty one first."""
        if self.ends is not None:
            return np.array([self.count(k) for k in range(len(self.text) + 1)], np.int64)
        out = np.zeros(len(self.text) + 1, np.int64)
        for start, word, n in zip(self.starts, self.words, self.upto):
            out[start + 1 : start + 1 + len(word)] = self.counter.tables(word)[1:]
            out[start + 1 : start + 1 + len(word)] += n
        # white space after a word costs nothing
        inside = np.zeros(len(out), bool)
        for start, word in zip(self.starts, self.words):
            inside[start + 1 : start + 1 + len(word)] = True
        last = np.maximum.accumulate(np.where(inside, np.arange(len(out)), 0))
        return out[last]


class PrefixCounts:
    """Exact counts of every prefix of one text: ``count(k)`` is what encoding its
    first k characters alone gives."""

    def __init__(self, counter: Counter, text: str):
        self.text = text
        found = list(counter.split_special.finditer(text)) if counter.split_special else []
        edges = [0, *(x for m in found for x in m.span()), len(text)]
        # a stretch before each special string and one after the last; counts before each
        self.parts = [Stretch(counter, text[a:b], a) for a, b in zip(edges[::2], edges[1::2])]
        self.before = np.concatenate(([0], np.cumsum([p.upto[-1] + 1 for p in self.parts]))).tolist()
        self.total = self.before[-1] - 1

    def count(self, k: int) -> int:
        k = min(max(k, 0), len(self.text))
        at = bisect_right(self.parts, k, key=lambda p: p.start) - 1
        part = self.parts[at]
        own = k - part.start
        if own <= len(part.text):
            return self.before[at] + part.count(own)
        # inside a special string, which is plain text as far as it is there
        return self.before[at] + part.with_tail(len(part.normal), part.counter.normal(self.text[part.start + len(part.text) : k]))

    def truncate(self, limit: int) -> int:
        """Most characters whose count keeps within the limit."""
        limit = max(limit, 0)
        at = bisect_right(self.before, limit) - 1
        if at >= len(self.parts):
            return len(self.text)
        part = self.parts[at]
        own = part.most(limit - self.before[at])
        k = part.start + own
        if own < len(part.text) or at + 1 == len(self.parts):
            return k
        # the special string after it does not fit whole, but parts of it may
        end = self.parts[at + 1].start
        return max(j for j in range(k, end) if self.count(j) <= limit)

    def table(self) -> np.ndarray:
        """Counts of all prefixes, the empty one first."""
        out = []
        for i, p in enumerate(self.parts):
            end = self.parts[i + 1].start if i + 1 < len(self.parts) else len(self.text) + 1
            out += [p.table() + self.before[i], np.array([self.count(k) for k in range(p.start + len(p.text) + 1, end)], np.int64)]
        return np.concatenate(out)


def counter(path: str) -> Counter:
    """The counter of a tokenizer file, loaded once a worker."""
    return held(("token counts", path), lambda: Counter(path))


def token_counts_column(text: Column, path: str, limit: int) -> Column:
    """Struct of the tokens of each whole text, and the most characters of it that
    keep within ``limit`` tokens."""

    @F.arrow_udf("n_tokens long, limit_chars long")
    def run(col: pa.Array) -> pa.Array:
        c, n, most = counter(path), [], []
        for part in texts(col):
            for t in part:
                n.append(c.count(t))
                most.append(len(t or "") if n[-1] <= limit else c.prefixes(t).truncate(limit))
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(most, pa.int64())], names=["n_tokens", "limit_chars"])

    return run.asNondeterministic()(text)


def prefix_counts_column(text: Column, path: str) -> Column:
    """array<int> of the counts of all prefixes of each text, the empty one first:
    element k + 1 answers what a cut after k characters costs."""

    @F.arrow_udf("array<int>")
    def run(col: pa.Array) -> pa.Array:
        c = counter(path)
        return pa.array([c.prefixes(t).table().astype(np.int32) for part in texts(col) for t in part], pa.list_(pa.int32()))

    return run.asNondeterministic()(text)


def chars_within(prefix_counts: Column, limit: Column | int) -> Column:
    """Most characters within a limit, from stored prefix counts alone."""
    limit = F.greatest(F.lit(limit) if isinstance(limit, int) else limit, F.lit(0))
    return F.array_max(F.transform(prefix_counts, lambda n, k: F.when(n <= limit, k).otherwise(F.lit(0))))


def token_counts(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, limit_chars) of every row of ``docs``."""
    text = F.col(f"`{text_col}`")
    out = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), token_counts_column(text, path, limit).alias("x"))
    return out.select("doc_id", "n_bytes", "x.n_tokens", (F.col("x.n_tokens") > limit).alias("over_limit"), "x.limit_chars")
