"""SentencePiece encoding and decoding with an Aho-Corasick driven dynamic program.

The model file's own kind decides what is relaxed over the output links (see
:mod:`palimpsest.llm.bpe`): best scores for a unigram model (single-pass
Viterbi), the merge test for a BPE model. A BPE file's scores are merge ranks
and the segmentation of greatest score sum is not what it means, so only the
merge test gives the ids that the library gives.

Texts are cut where no piece of the vocabulary can reach across: before each
run of the space mark, at characters that no piece holds, and, if the
vocabulary has no piece that joins letters and other characters, between those.
Chunks repeat, so their encodings are kept in a bounded memo.

Defined results: a null or empty text has no ids and decodes to the empty text;
characters outside the vocabulary become byte pieces where the model has them,
else the unknown id. Decoding turns marks into spaces and drops the one that
encoding puts first; with byte pieces it gives back every text that holds no
space mark (U+2581) itself, which decodes to a space as in the library.
"""

from __future__ import annotations

import re
from array import array
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm._shared import held, texts
from palimpsest.llm.bpe import PAIR_BITS, Memo, Merges, automaton, best_pieces, last_pieces, trace

MARK = "▁"
#: Latin letters: vocabularies seldom join them with anything else, which is tested on loading.
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"


class Codec:
    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        m.ParseFromString(model)
        norm = m.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only models without text normalisation are supported")
        self.prefix = MARK if norm.add_dummy_prefix else ""
        self.pieces = [p.piece for p in m.pieces]
        kinds = [p.type for p in m.pieces]
        self.unknown = kinds.index(2)
        self.score = [p.score for p in m.pieces]
        self.unknown_score = min((s for s, k in zip(self.score, kinds) if k == 1), default=0.0) - 10.0
        own = {p: i for i, (p, k) in enumerate(zip(self.pieces, kinds)) if k in (1, 4)}
        self.own = own
        self.byte_ids = [i for i, k in enumerate(kinds) if k == 6]
        self.byte_of = {i: n for n, i in enumerate(self.byte_ids)}
        self.control = {i for i, k in enumerate(kinds) if k == 3}
        self.lengths = [len(p) for p in self.pieces]
        self.auto = automaton(own)
        self.chars = {c for p in own for c in p}
        self.is_bpe = m.trainer_spec.model_type == 2
        # a merge makes a piece from any two pieces that spell it; its rank is the piece's place by score
        if self.is_bpe:
            ranks = {s: r for r, s in enumerate(sorted({self.score[i] for i in own.values()}, reverse=True))}
            pairs = {}
            for p, i in own.items():
                for k in range(1, len(p)):
                    a, b = own.get(p[:k]), own.get(p[k:])
                    if a is not None and b is not None:
                        pairs[a, b] = (ranks[self.score[i]], i)
            self.merges = Merges(self.pieces, pairs)
            self.reach = self._first_merges(own, pairs, ranks)
        inner = any(MARK in p.lstrip(MARK) for p in own)
        letters = re.compile(f"[{LETTERS}]+")
        mixed = any(letters.search(q) and not letters.fullmatch(q) for p in own if (q := p.lstrip(MARK)))
        if inner:
            raise ValueError("a piece holds the space mark inside a word")
        words = f"[{LETTERS}]+|[^{LETTERS}{MARK}]+"
        self.cut = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+" if mixed else f"{MARK}*(?:{words})|{MARK}+")
        self.memo = Memo(self._chunk, longest=64)
        self.spelled = self._spell()

    def _first_merges(self, own, pairs, ranks):
        """Pieces that merging itself makes: with several ways to spell a piece
        only the way that merging takes leads to it."""
        made = {}
        for p, i in own.items():
            if len(p) == 1:
                made[i] = True
            elif set(p) != {MARK}:
                got = self.merges.encode_by_merging([own[c] for c in p]) if all(c in own for c in p) else []
                made[i] = got == [i]
                if made[i]:
                    self.merges.parts[i] = self._parts(p, own)
                    self.merges.rank[i] = ranks[self.score[i]]
        return made

    def _parts(self, piece: str, own) -> tuple[int, int]:
        """The two pieces of the last merge that makes ``piece``."""
        whole = own[piece]
        rank = self.merges.pairs
        ids = [own[c] for c in piece]
        while len(ids) > 2:
            k = min((k for k in range(len(ids) - 1) if (ids[k], ids[k + 1]) in rank and rank[ids[k], ids[k + 1]][1] != whole), key=lambda k: (rank[ids[k], ids[k + 1]][0], k))
            ids[k : k + 2] = [rank[ids[k], ids[k + 1]][1]]
        return ids[0], ids[1]

    def _known(self, text: str) -> list[int]:
        """Encoding of a string of known characters."""
        if not self.is_bpe:
            return [x for x, _, _ in best_pieces(self.auto, text, self.score, self.unknown, self.unknown_score)]
        if text.startswith(MARK * 2):
            # a run's own merges come last: the word takes the last mark if it can
            run = len(text) - len(text.lstrip(MARK))
            if run == len(text):
                return self.merges.encode_by_merging([self.own[MARK]] * run)
            word = self._known(text[run - 1 :])
            spare = run - 1 + (word[0] == self.own[MARK])
            return self.merges.encode_by_merging([self.own[MARK]] * spare) + word[word[0] == self.own[MARK] :]
        last, _ = last_pieces(self.auto, self, text)
        return trace(last, self.lengths)

    # the dynamic program asks its merges through these two
    @property
    def _apart(self):
        return self

    @property
    def young(self):
        return self.merges._apart.young

    def __call__(self, pair):
        if not self.reach.get(pair & (1 << PAIR_BITS) - 1):
            return False
        return self.merges._apart(pair)

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a chunk as 32-bit integers, so that a text's ids are one join."""
        out: list[int] = []
        if self.chars.issuperset(chunk):
            out = self._known(chunk)
        else:
            start = 0
            for i, c in enumerate(chunk):
                if c not in self.chars:
                    if i > start:
                        out += self._known(chunk[start:i])
                    out += [self.byte_ids[b] for b in c.encode("utf-8", "surrogatepass")] if self.byte_ids else [self.unknown]
                    start = i + 1
            if start < len(chunk):
                out += self._known(chunk[start:])
        return array("i", out).tobytes()

    def encode_array(self, text: str | None) -> np.ndarray:
        """Ids of a whole text, without begin or end, as int32."""
        if not text:
            return np.empty(0, np.int32)
        chunks = self.cut.findall(self.prefix + text.replace(" ", MARK))
        found = list(map(self.memo.young.get, chunks))
        if None in found:
            memo = self.memo
            found = [memo(chunk) if ids is None else ids for chunk, ids in zip(chunks, found)]
        return np.frombuffer(b"".join(found), np.int32)

    def encode(self, text: str | None) -> list[int]:
        return self.encode_array(text).tolist()

    def decode_array(self, ids: np.ndarray) -> str:
        """Text of int32 ids; bytes that are no UTF-8 become U+FFFD."""
        if not len(ids):
            return ""
        starts, lens, data = self.spelled
        size = lens[ids]
        ends = np.cumsum(size)
        place = np.repeat(starts[ids] - ends + size, size) + np.arange(ends[-1])
        out = data[place].tobytes().decode("utf-8", "replace")
        return out[1:] if self.prefix and out.startswith(" ") else out

    def decode(self, ids: list[int] | None) -> str:
        return self.decode_array(np.array(ids or [], np.int32))

    def _spell(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, bytes) of what each id decodes to."""
        out = []
        for i, p in enumerate(self.pieces):
            if i in self.byte_of:
                out.append(bytes([self.byte_of[i]]))
            elif i in self.control:
                out.append(b"")
            else:
                out.append(" \u2047 ".encode() if i == self.unknown else p.replace(MARK, " ").encode())
        lens = np.array([len(x) for x in out], np.int64)
        return np.cumsum(lens) - lens, lens, np.frombuffer(b"".join(out), np.uint8)


def codec(path: str) -> Codec:
    """The codec of a model file, loaded once a worker."""
    return held(("sentencepiece", path), lambda: Codec(Path(path).read_bytes()))


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    """Arrow lists of 32-bit integers."""
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    values = np.concatenate(arrays) if arrays else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))


def encode_column(text: Column, path: str) -> Column:
    """array<int> of ids; empty for null."""

    @F.arrow_udf("array<int>")
    def run(col: pa.Array) -> pa.Array:
        c = codec(path)
        parts = [_lists([c.encode_array(t) for t in part]) for part in texts(col)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))

    return run.asNondeterministic()(text)


def decode_column(ids: Column, path: str) -> Column:
    """The text of an array<int> of ids; empty for null."""

    @F.arrow_udf("string")
    def run(col: pa.Array) -> pa.Array:
        c, out = codec(path), []
        for k in range(len(col)):
            own = col[k].values
            out.append("" if own is None else c.decode_array(own.to_numpy(zero_copy_only=False)))
        return pa.array(out, pa.string())

    return run.asNondeterministic()(ids)


def checked_column(text: Column, path: str) -> Column:
    """Struct (ids, round_trip): the ids of each whole text, and whether decoding
    them gives it back. Both happen in one pass, so ids are not sent out and in again."""

    @F.arrow_udf("ids array<int>, round_trip boolean")
    def run(col: pa.Array) -> pa.Array:
        c, ids, same = codec(path), [], []
        for part in texts(col):
            own = [c.encode_array(t) for t in part]
            same += [c.decode_array(x) == (t or "") for x, t in zip(own, part)]
            ids.append(_lists(own))
        lists = pa.concat_arrays(ids) if ids else pa.array([], pa.list_(pa.int32()))
        return pa.StructArray.from_arrays([lists, pa.array(same, pa.bool_())], names=["ids", "round_trip"])

    return run.asNondeterministic()(text)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids, round_trip) of every row: ids decode to the text."""
    out = docs.select(F.col(f"`{id_col}`").alias("doc_id"), checked_column(F.col(f"`{text_col}`"), path).alias("x"))
    return out.select("doc_id", F.size("x.ids").cast("long").alias("n_tokens"), "x.ids", "x.round_trip")
