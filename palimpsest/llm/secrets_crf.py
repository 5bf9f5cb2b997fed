"""Secret scans: fixed patterns, and a linear-chain conditional random field.

The patterns find assignments, access keys and long hex runs. The field tags
the words of a text as begin (B), inside (I) or outside (O) of a secret, from
the word's shape, its neighbours and features of the whole text, and adds the
spans that no pattern has touched. Decoding is exact Viterbi.

A word's contribution depends on the word alone, so it is kept in a bounded
memo as nine numbers: scores of the three tags for itself, and what it lends to
the next and to the previous word. A word whose O score leads by more than all
transitions together could change is O on every best path, so the chain falls
apart there and Viterbi runs only over the stretches between such words; the
result is that of Viterbi over the whole text.

The field is fitted to words marked by the patterns, in windows of words around
them, around words that look alike but are not marked, and around any. Every text
and every word is eligible, whatever its length: of all texts the ``max_docs`` with
and as many without a pattern whose hash is smallest are read whole, and of all
their windows the ``max_windows`` of each of the three kinds whose hash is smallest
are taken. These are the bounds of the sample; a window leaves a text as shapes and
tags. Secrets are also swapped for random ones of other shapes and behind other
keywords, so that the field learns shapes and contexts that the patterns lack.

Defined results: a null or empty text has no spans; texts and words of any length
are scanned whole, in time linear in them; of overlapping spans those of the
patterns stay and the field's go; a corpus without any pattern gives a field that
adds nothing; repeated rows get equal results; an empty table gives an empty one.
Extra columns are kept by ``redact`` and not read by ``scan``; null texts stay null.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm._shared import fresh_name, held, materialize, texts
from palimpsest.llm.bpe import Memo

#: Fixed values of the contract.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: A run is matched whole from its first character, so the floor can stand in the pattern.
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "crf")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
CORE = re.compile(r"[A-Za-z0-9+/_=~.:@%\-]+")
KEYWORD = re.compile(rb"(?i)pass(word|wd|phrase)?\b|pwd\b|secret|token|api_?key|access_?key|credential|bearer|authorization|private")

O, B, I = 0, 1, 2
SHAPE = 40


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns, sorted; whole matches."""
    found = []
    found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def spell(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


_CLASS = bytes(
    ord("d") if chr(c).isdigit() and c < 128 else ord("l") if 97 <= c <= 122 else ord("U") if 65 <= c <= 90 else ord("h") if c >= 128
    else ord("q") if c in b"\"'`" else ord("e") if c in b"=:" else ord("s") if c in b"+/_-." else ord("@") if c == 64 else ord("p")
    for c in range(256)
)


def shape(word: bytes) -> tuple[int, ...]:
    """Indices of the features that hold for a word's shape."""
    kinds = word.translate(_CLASS)
    n = len(word)
    letters, upper, digits = kinds.count(b"l"), kinds.count(b"U"), kinds.count(b"d")
    core = letters + upper + digits + kinds.count(b"s")
    out = [0, 1 + min(9, n.bit_length())]
    if digits:
        out.append(11 + min(3, int(4 * digits / n)))
        if letters or upper:
            out.append(15)
            if core >= 16:
                out.append(16)
            switches = sum(1 for a, b in zip(kinds, kinds[1:]) if a != b)
            out.append(17 + min(3, int(4 * switches / n)))
            if letters and upper:
                out.append(21)
        if digits + letters + upper == 0 or digits >= 0.8 * n:
            out.append(22)
    if letters and upper > 1 and upper < n - 2:
        out.append(23)
    if core >= 20:
        out.append(24)
        if len(set(word)) >= 12:
            out.append(25)
    if kinds[:1] == b"q" or kinds[-1:] == b"q":
        out.append(26)
    if kinds[-1:] == b"e":
        out.append(27)
    if kinds == b"e" or kinds == b"ee":
        out.append(28)
    if b"e" in kinds[1:-1]:
        out.append(29)
    if b"@" in kinds:
        out.append(30)
    if b"h" in kinds:
        out.append(31)
    if kinds.count(b"p") > 0:
        out.append(32)
    if word.count(b".") == 3 and digits >= 4:
        out.append(33)
    if b"://" in word or word[:4] == b"www.":
        out.append(34)
    if KEYWORD.search(word):
        out.append(35)
        if core <= 12:
            out.append(36)
    if word[:4] in (b"AKIA", b"ghp_", b"gho_", b"xoxb", b"sk_l", b"eyJh", b"----", b"ssh-"):
        out.append(37)
    if letters + upper == n:
        out.append(38)
    if letters == n:
        out.append(39)
    return tuple(out)


#: Features of a whole text, each paired with every word of digits and letters.
FILE = 4


def file_features(text: str) -> tuple[float, ...]:
    n = len(text) + 1
    code = sum(map(text.count, "{}();=")) / n
    return (min(1.0, 40 * code), min(1.0, math.log1p(n) / 12), float("BEGIN" in text or "PRIVATE KEY" in text), min(1.0, 10 * sum(map(text.count, "0123456789")) / n))


@dataclass
class Field:
    """Weights: own, from the previous word, from the next word, of the file; transitions."""

    own: np.ndarray
    before: np.ndarray
    after: np.ndarray
    file: np.ndarray
    moves: np.ndarray

    @classmethod
    def outside(cls) -> Field:
        """A field that tags all words O."""
        zero = np.zeros((SHAPE, 3))
        own = zero.copy()
        own[:, O] = 100.0
        return cls(own, zero, zero, np.zeros((FILE, 3)), np.zeros((3, 3)))


def viterbi(scores: np.ndarray, moves: np.ndarray) -> list[int]:
    """Best tags of one chain; of equal paths the lowest tags last to first."""
    rows, m = scores.tolist(), moves.tolist()
    best, back = rows[0], []
    for row in rows[1:]:
        at, new = [], []
        for t in range(3):
            ways = (best[0] + m[0][t], best[1] + m[1][t], best[2] + m[2][t])
            k = 0 if ways[0] >= ways[1] and ways[0] >= ways[2] else 1 if ways[1] >= ways[2] else 2
            at.append(k)
            new.append(ways[k] + row[t])
        back.append(at)
        best = new
    out = [best.index(max(best))]
    for at in reversed(back):
        out.append(at[out[-1]])
    return out[::-1]


class Tagger:
    def __init__(self, model: Field):
        self.model = model
        self.by_shape: dict[tuple, tuple] = {}
        self.memo = Memo(self._contributions, longest=64)
        m = model.moves
        self.lead = 2 * float(m.max() - m.min()) + 1e-9
        self.rows: dict[tuple, int] = {}

    def _contributions(self, word: bytes) -> int:
        key = shape(word)
        row = self.by_shape.get(key)
        if row is None:
            at = list(key)
            m = self.model
            row = self.by_shape[key] = len(self.by_shape)
            entry = np.concatenate([m.own[at].sum(0), m.before[at].sum(0), m.after[at].sum(0)])
            if row == 0:
                self.table = np.zeros((1024, 9))
            elif row >= len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[row] = entry
        return row

    def scores(self, words: list[bytes], text: str) -> np.ndarray:
        memo, young, ids = self.memo, self.memo.young, []
        add = ids.append
        for w in words:
            i = young.get(w)
            if i is None:
                i, young = memo(w), memo.young
            add(i)
        rows = self.table[np.array(ids, np.int64)]
        out = rows[:, :3] + np.array(file_features(text)) @ self.model.file
        out[1:] += rows[:-1, 3:6]
        out[:-1] += rows[1:, 6:9]
        return out

    def tags(self, words: list[bytes], text: str) -> dict[int, int]:
        """The words that are not O on the best path, and their tags."""
        if not words:
            return {}
        scores = self.scores(words, text)
        open_ = scores[:, 1:].max(1) + self.lead >= scores[:, 0]
        at = np.flatnonzero(open_)
        out: dict[int, int] = {}
        if not len(at):
            return out
        for run in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1):
            lo, hi = max(int(run[0]) - 1, 0), min(int(run[-1]) + 2, len(words))
            part = scores[lo:hi].copy()
            for edge, sure in ((0, not open_[lo]), (-1, not open_[hi - 1])):
                if sure:  # certain to be O
                    part[edge, 1:] = -1e9
            for k, t in enumerate(viterbi(part, self.model.moves)):
                if t != O:
                    out[lo + k] = t
        return out


def tagged_spans(text: str, words: list[bytes], tags: dict[int, int]) -> list[tuple[int, int]]:
    """Code point spans of runs of tagged words, trimmed to secret characters."""
    if not tags:
        return []
    places = [(m.start(), m.end()) for m in WORD.finditer(text)]
    spans, last = [], None
    for k in sorted(tags):
        if tags[k] == I and last == k - 1:
            spans[-1][1] = places[k][1]
        else:
            spans.append([places[k][0], places[k][1]])
        last = k
    out = []
    for a, b in spans:
        cores = [m.span() for m in CORE.finditer(text, a, b)]
        if cores:
            out.append((cores[0][0], cores[-1][1]))
    return out


def joined(spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Stretches (start, end) that sorted spans cover, apart from one another."""
    out: list[list[int]] = []
    for a, _, b in spans:
        if out and a < out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def apart(own: list[tuple[int, int]], taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of sorted stretches those that meet none of other sorted stretches."""
    out, k = [], 0
    for a, b in own:
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if k == len(taken) or taken[k][0] >= b:
            out.append((a, b))
    return out


def find(text: str, tagger: Tagger) -> list[tuple[int, int, int]]:
    """All spans (start, kind, end), sorted: the patterns' and those the field adds."""
    spans = base_spans(text)
    words = text.encode("utf-8", "surrogatepass").split()
    tags = tagger.tags(words, text)
    if tags:
        spans = sorted(spans + [(a, 3, b) for a, b in apart(tagged_spans(text, words, tags), joined(spans))])
    return spans


# ---------------------------------------------------------------- fitting


def _tags_of(text: str, spans: list[tuple[int, int, int]]) -> tuple[list[bytes], list[int]]:
    words, tags, taken, k = [], [], joined(spans), 0
    for m in WORD.finditer(text):
        words.append(m[0].encode("utf-8", "surrogatepass"))
        while k < len(taken) and taken[k][1] <= m.start():
            k += 1
        inside = k < len(taken) and taken[k][0] < m.end()
        tags.append(O if not inside else B if m.start() <= taken[k][0] else I)
    return words, tags


KEYS = ("password", "passwd", "pwd", "passphrase", "secret", "client_secret", "token", "auth_token", "api_key", "access_key", "credential", "private_key")


def _other_secret(rng: random.Random) -> str:
    letters = string.ascii_letters + string.digits
    some = lambda chars, n: "".join(rng.choices(chars, k=n))
    kinds = (
        lambda: some(string.ascii_lowercase, rng.randint(2, 6)) + rng.choice("-_") + some(letters, rng.randint(20, 40)),
        lambda: some(string.ascii_uppercase, 4) + some(string.ascii_uppercase + string.digits, rng.choice((16, 20, 28))),
        lambda: some(letters + "+/", rng.randint(28, 60)) + rng.choice(("", "=", "==")),
        lambda: some(string.ascii_lowercase, 2) + "_" + some(string.ascii_lowercase, 4) + "_" + some(letters, 24),
        lambda: "eyJ" + some(letters + "-_", rng.randint(20, 60)) + "." + some(letters + "-_", rng.randint(20, 60)) + "." + some(letters + "-_", 43),
        lambda: some(rng.choice(("0123456789abcdef", "0123456789ABCDEF")), rng.choice((24, 32, 40, 64))),
        lambda: "-".join(some(letters, rng.choice((4, 6, 12))) for _ in range(rng.randint(3, 5))),
    )
    return rng.choice(kinds)()


def _password(rng: random.Random) -> str:
    return "".join(rng.choices(string.ascii_letters + string.digits * 2 + "!#$%*_.-", k=rng.randint(8, 18)))


#: Words of a window, and the kinds of windows: around a marked word, around one
#: that looks alike but is not marked, and around any.
LENGTH, NEAR, ALIKE, ANY = 13, 0, 1, 2
#: Tasks that cut the sample's texts into windows.
WINDOW_TASKS = 32
ALIKE_WORD = re.compile(KEYWORD.pattern + rb"|[0-9@#$%&|]")
WINDOW = pa.schema([("kind", pa.int32()), ("h", pa.int64()), ("shapes", pa.list_(pa.int64())), ("tags", pa.list_(pa.int32())), ("file", pa.list_(pa.float64()))])


def _bits(word: bytes) -> int:
    """A word's shape as a number with a bit a feature; 0 for no word."""
    return sum(1 << k for k in shape(word)) if word else 0


def windows_of(text: str) -> list[dict]:
    """All windows of a text: one a marked word, one a word that looks alike and one
    for every 64th word by hash, placed by the hash too."""
    words, tags = _tags_of(text, base_spans(text))
    if not words:
        return []
    file, seed = list(file_features(text)), xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))
    bits: dict[bytes, int] = {}
    out = []
    for k, (w, t) in enumerate(zip(words, tags)):
        h = xxhash.xxh3_64_intdigest(k.to_bytes(8, "little"), seed)
        kinds = [NEAR] if t == B else [ALIKE] if t == O and ALIKE_WORD.search(w) else []
        if h % 64 == 0 or len(words) < 64 and k == seed % len(words):
            kinds.append(ANY)
        for kind in kinds:
            at = min(max(0, k - h // 64 % (LENGTH - 2)), max(0, len(words) - LENGTH))
            x, y = [bits[w] if w in bits else bits.setdefault(w, _bits(w)) for w in words[at : at + LENGTH]], tags[at : at + LENGTH]
            pad = LENGTH - len(x)
            out.append({"kind": kind, "h": h - (1 << 63), "shapes": x + [0] * pad, "tags": y + [O] * pad, "file": file})
    return out


def variants(x: list[int], y: list[int], rng: random.Random) -> list[tuple[list[int], list[int]]]:
    """A window with its first secret swapped: for one that stands alone, for one
    behind the same words, for a password behind another keyword, in two words and
    in one; and that keyword with a plain word, which is none."""
    if B not in y:
        return []
    first = y.index(B)
    run = 1
    while first + run < LENGTH and y[first + run] == I:
        run += 1
    quoted = 1 << 26

    def put(middle: list[int], tags: list[int]) -> tuple[list[int], list[int]]:
        a, b = (x[:first] + middle + x[first + run :])[:LENGTH], (y[:first] + tags + y[first + run :])[:LENGTH]
        return a + [0] * (LENGTH - len(a)), b + [O] * (LENGTH - len(b))

    out = [put([_bits(_other_secret(rng).encode())], [B])]
    if run > 1:
        quote = '"' if x[first + run - 1] & quoted else ""
        out.append(put([*x[first : first + run - 1], _bits((quote + _other_secret(rng) + quote).encode())], [B] + [I] * (run - 1)))
    key, sep, value = rng.choice(KEYS), rng.choice("=:"), rng.choice((_password, _other_secret))(rng)
    out.append(put([_bits((key + sep).encode()), _bits(value.encode())], [B, I]))
    out.append(put([_bits((key + sep + value).encode())], [B]))
    plain = "".join(rng.choices(string.ascii_lowercase, k=rng.randint(2, 9)))
    out.append(put([_bits(key.encode()), _bits(plain.encode())], [O, O]))
    return out


def fit_field(found: list[tuple[int, list[int], list[int], list[float]]], steps: int = 100, rate: float = 0.15, decay: float = 2e-4, seed: int = 42) -> Field:
    """Maximum likelihood of the tags of windows (kind, shapes, tags, file), by
    Adam with forward-backward. Scores and gradients go by distinct shapes."""
    if not any(kind == NEAR for kind, *_ in found):
        return Field.outside()
    rng, xs, ys, fs = random.Random(seed), [], [], []
    for _, x, y, f in found:
        for a, b in [(x, y), *variants(x, y, rng)]:
            xs.append(a)
            ys.append(b)
            fs.append(f)
    y, f, n = np.array(ys, np.int64), np.array(fs, np.float64), len(xs)
    kinds, at = np.unique(np.array(xs, np.int64), return_inverse=True)
    at = at.reshape(n, LENGTH)
    table = (kinds[:, None] >> np.arange(SHAPE) & 1).astype(np.float64)
    # where a word's shape counts: for itself, for the word after it, for the word before it
    places = ((slice(None), slice(None)), (slice(None), slice(1, None)), (slice(None), slice(None, -1)))
    sources = (at, at[:, :-1], at[:, 1:])
    w = [np.zeros((SHAPE, 3)) for _ in range(3)] + [np.zeros((FILE, 3)), np.zeros((3, 3))]
    gold, pair_gold = np.eye(3)[y], np.zeros((3, 3))
    np.add.at(pair_gold, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
    ones = np.ones((3, 1))  # sums over three tags
    first, second = [np.zeros_like(v) for v in w], [np.zeros_like(v) for v in w]
    for step in range(1, steps + 1):
        e = np.repeat((f @ w[3])[:, None], LENGTH, 1)
        for place, source, own in zip(places, sources, w):
            e[place] += (table @ own)[source]
        psi, moves = np.exp(e - e.max(2, keepdims=True)), np.exp(w[4])
        alpha, beta = np.empty_like(psi), np.ones_like(psi)
        alpha[:, 0] = psi[:, 0] / (psi[:, 0] @ ones)
        for k in range(1, LENGTH):
            a = (alpha[:, k - 1] @ moves) * psi[:, k]
            alpha[:, k] = a / (a @ ones)
        pairs = np.zeros((3, 3))
        for k in range(LENGTH - 2, -1, -1):
            ahead = psi[:, k + 1] * beta[:, k + 1]
            b = ahead @ moves.T
            norm = (alpha[:, k] * b) @ ones
            pairs += alpha[:, k].T @ (ahead / norm) * moves
            beta[:, k] = b / (b @ ones)
        p = alpha * beta
        p /= p @ ones
        off = (gold - p) / n
        grads = []
        for place, source in zip(places, sources):
            d, s = off[place].reshape(-1, 3), source.ravel()
            grads.append(table.T @ np.stack([np.bincount(s, d[:, t], len(kinds)) for t in range(3)], 1))
        grads += [f.T @ off.sum(1), (pair_gold - pairs) / n]
        for k, (g, v) in enumerate(zip(grads, w)):
            g = g - decay * v
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            v += rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return Field(*w)


def likely_marked(text: Column) -> Column:
    """A cheap test by which the sample finds texts with a pattern. It need not be
    exact: tags come from the patterns themselves."""
    key = r"[:=](?<=(?i:password|passwd|secret|token|apikey|api_key)[\"']{0,1} {0,3}[:=])"
    return text.contains("AKIA") | text.rlike(key) | text.rlike("[0-9a-f]{24}")


def fit(docs: DataFrame, text_col: str = "text", max_docs: int = 1500, max_windows: int = 2500, **options) -> Field:
    """Fit on windows of at most ``max_docs`` texts with a pattern and as many
    without, at most ``max_windows`` of a kind (see the module's text)."""
    some = docs.select(F.col(f"`{text_col}`").alias("text")).filter("length(text) > 0")
    keyed = materialize(some.select(F.xxhash64("text").alias("h"), likely_marked(F.col("text")).alias("marked")), "secret-keys")
    pick = [keyed.filter(F.col("marked") == flag).select("h").distinct().orderBy("h").limit(max_docs) for flag in (True, False)]
    # a top-k of hashes bounds what is broadcast
    hashes = materialize(pick[0].unionByName(pick[1]).withColumnRenamed("h", "own"), "secret-sample")
    got = some.withColumn("h", F.xxhash64("text")).join(F.broadcast(hashes), F.col("h") == F.col("own")).groupBy("h").agg(F.min("text").alias("text"))

    def run(batches):
        for batch in batches:
            for part in texts(batch.column("text")):
                for t in part:
                    rows = windows_of(t)
                    for i in range(0, len(rows), 4096):
                        yield pa.RecordBatch.from_pylist(rows[i : i + 4096], WINDOW)

    found = materialize(got.select("text").repartition(WINDOW_TASKS).mapInArrow(run, "kind int, h long, shapes array<long>, tags array<int>, file array<double>"), "secret-windows")
    rows = []
    for kind in (NEAR, ALIKE, ANY):
        rows += found.filter(F.col("kind") == kind).orderBy("h", "shapes", "tags", "file").limit(max_windows).collect()
    return fit_field([(r["kind"], r["shapes"], r["tags"], r["file"]) for r in rows], **options)


# ---------------------------------------------------------------- columns

RESULT = pa.struct([("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])
def _tagger(model: Field) -> Tagger:
    """One tagger a worker and model, so that its memo lives across tasks."""
    key = hashlib.sha256(b"".join(np.ascontiguousarray(a).tobytes() for a in (model.own, model.before, model.after, model.file, model.moves))).digest()
    return held(("secrets", key), lambda: Tagger(model))


def scan_column(text: Column, model: Field) -> Column:
    """Struct of RESULT for each whole text."""

    @F.arrow_udf("n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    def run(col: pa.Array) -> pa.Array:
        tagger, rows = _tagger(model), []
        for part in texts(col):
            for t in part:
                spans = find(t or "", tagger)
                base = [s for s in spans if s[1] < 3]
                kinds = [k for _, k, _ in base]
                rows.append({"n_assign": kinds.count(0), "n_access": kinds.count(1), "n_hex": kinds.count(2), "base_sha256": hashlib.sha256(spell(base).encode()).hexdigest(), "spans": spell(spans)})
        return pa.array(rows, RESULT)

    return run.asNondeterministic()(text)


def redact_text(text: str, spans: list[tuple[int, int, int]], mask: str = "[SECRET]") -> str:
    """The text with each stretch of overlapping spans replaced by the mask."""
    out, at, last = [], 0, -1
    for a, _, b in spans:
        if a >= last:
            out += [text[at:a], mask]
        at = last = max(last, b)
    return "".join([*out, text[at:]])


def redact_column(text: Column, model: Field) -> Column:
    """Each text with its secrets masked; null stays null, clean texts as they are."""

    @F.arrow_udf("string")
    def run(col: pa.Array) -> pa.Array:
        tagger, out = _tagger(model), []
        for part in texts(col):
            for t in part:
                spans = find(t, tagger) if t else []
                out.append(redact_text(t, spans) if spans else t)
        return pa.array(out, pa.string())

    return run.asNondeterministic()(text)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Field | None = None, **options) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every row."""
    model = model or fit(docs, text_col, **options)
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), scan_column(F.col(f"`{text_col}`"), model).alias("x")).select("doc_id", "x.*")


def redact(docs: DataFrame, text_col: str = "text", model: Field | None = None, length_col: str | None = None, **options) -> DataFrame:
    """``docs`` with secrets masked in ``text_col`` and, if named, ``length_col`` set to the new length."""
    model = model or fit(docs, text_col, **options)
    tmp = fresh_name(docs.columns, "redacted")
    out = docs.withColumn(tmp, redact_column(F.col(f"`{text_col}`"), model))
    cols = [F.col(tmp).alias(c) if c == text_col else F.length(tmp).cast(docs.schema[c].dataType).alias(c) if c == length_col else F.col(f"`{c}`") for c in docs.columns]
    return out.select(*cols)
