"""Aho-Corasick dynamic programs over subword vocabularies.

An automaton over the vocabulary reads a string once; at each position its
output links give all pieces that end there, longest first. For a unigram model
the best score of each prefix is relaxed over them (Viterbi). For a merge (BPE)
model each prefix has exactly one last piece in its encoding: the one whose
predecessor, the last piece of the prefix before it, stays apart from it under
the merges. That one test in place of the maximum gives the same tokens as
merging does, in one pass and for every prefix at once.
"""

from __future__ import annotations

import heapq

import ahocorasick

#: Entries a memo holds before it turns over; two generations are kept.
MEMO = 160_000
#: A pair of pieces is one integer, which the garbage collector need not visit.
PAIR_BITS = 20


class Memo:
    """A bounded memo: when it is full it becomes the old generation, and what
    is asked for again moves on. Keys over ``longest`` characters (0: no bound) are
    not kept, so its bytes are bounded too. ``young`` is open to callers for fast lookups."""

    def __init__(self, make, size: int = MEMO, longest: int = 0):
        self.make, self.size, self.longest, self.young, self.old = make, size, longest, {}, {}

    def __call__(self, key):
        value = self.young.get(key)
        if value is None:
            value = self.old.get(key)
            if value is None:
                value = self.make(key)
                if self.longest and len(key) > self.longest:
                    return value
            if len(self.young) >= self.size:
                self.old, self.young = self.young, {}
            self.young[key] = value
        return value


class Merges:
    """A merge vocabulary: symbols, and the rank of the merge that makes each.

    ``rank[x]`` is -1 for a symbol that no merge makes; ``parts[x]`` are the two
    symbols that make it. Lower ranks merge first, leftmost among equal ones."""

    def __init__(self, symbols: list[str], pairs: dict[tuple[int, int], tuple[int, int]]):
        self.symbols, self.pairs = symbols, pairs
        self.rank, self.parts = [-1] * len(symbols), [None] * len(symbols)
        for (a, b), (rank, made) in sorted(pairs.items(), key=lambda x: x[1]):
            if self.rank[made] < 0:
                self.rank[made], self.parts[made] = rank, (a, b)
        self._apart = Memo(self._stay_apart, 100_000)

    def apart(self, left: int, right: int) -> bool:
        return self._apart(left << PAIR_BITS | right)

    def _stay_apart(self, pair: int) -> bool:
        """Whether two adjacent pieces, each the encoding of its own text, are
        the encoding of the text of both. Undo their merges, latest first; if at
        some moment the symbols at the cut would have merged before the later of
        the merges undone so far, they don't stay apart."""
        left, right = pair >> PAIR_BITS, pair & (1 << PAIR_BITS) - 1
        limit = (1 << 60, 0)  # rank of the merge just undone, and whether it was to the right
        while True:
            met = self.pairs.get((left, right))
            if met is not None and self._before(met[0], limit):
                return False
            a, b = self.rank[left], self.rank[right]
            if a < 0 and b < 0:
                return True
            # of equal ranks the left one merged first, so the right one is undone first
            if a > b:
                limit, left = (a, -1), self.parts[left][1]
            else:
                limit, right = (b, 1), self.parts[right][0]

    @staticmethod
    def _before(rank: int, limit: tuple[int, int]) -> bool:
        # a merge at the cut comes before one of the same rank to its right, after one to its left
        return rank < limit[0] or rank == limit[0] and limit[1] > 0

    def encode_by_merging(self, ids: list[int]) -> list[int]:
        """Merge by rank with a heap: O(n log n), the definition that the dynamic
        program must equal; used where ranks tie along long runs."""
        n = len(ids)
        ids, after, prior = list(ids), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(self.pairs[p][0], i, p) for i in range(n - 1) if (p := (ids[i], ids[i + 1])) in self.pairs]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i] if ids[i] is not None else n
            if j >= n or (ids[i], ids[j]) != pair:
                continue
            ids[i], ids[j] = self.pairs[pair][1], None
            after[i] = after[j]
            if after[i] < n:
                prior[after[i]] = i
            for k in (prior[i], i):
                if k >= 0 and after[k] < n and (p := (ids[k], ids[after[k]])) in self.pairs:
                    heapq.heappush(heap, (self.pairs[p][0], k, p))
        return [x for x in ids if x is not None]


def automaton(pieces: dict[str, int]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for piece, x in pieces.items():
        a.add_word(piece, (len(piece), x))
    a.make_automaton()
    return a


def last_pieces(auto: ahocorasick.Automaton, merges: Merges, text: str) -> tuple[list[int], list[int]]:
    """For each prefix of ``text``: the last piece of its encoding and the
    number of pieces (-1 where a prefix cannot be encoded)."""
    last, count = [-1] * (len(text) + 1), [-1] * (len(text) + 1)
    count[0] = 0
    apart, young = merges._apart, merges._apart.young
    for end, (length, x) in auto.iter(text):
        end += 1
        if last[end] >= 0:
            continue
        start = end - length
        if start == 0:
            last[end], count[end] = x, 1
        elif count[start] > 0:
            pair = last[start] << PAIR_BITS | x
            ok = young.get(pair)
            if ok is None:
                ok = apart(pair)
                young = merges._apart.young
            if ok:
                last[end], count[end] = x, count[start] + 1
    return last, count


def prefix_counts(auto: ahocorasick.Automaton, merges: Merges, text: str) -> list[int]:
    """Pieces of each prefix of ``text`` that is encoded alone, in one pass (-1
    where the program finds none).

    The automaton's values are (length, piece, closing piece): what the string is
    inside a text, and what it is as the end of one (-1 if it is none). For each
    prefix the pass keeps its last piece and number of pieces if more follows, and
    asks which closing piece stays apart from what comes before it."""
    last, count, closed = [-1] * (len(text) + 1), [-1] * (len(text) + 1), [-1] * (len(text) + 1)
    count[0] = closed[0] = 0
    apart, young = merges._apart, merges._apart.young
    for end, (length, inside, closing) in auto.iter(text):
        end += 1
        start = end - length
        before = count[start]
        if before < 0 or start and not before:
            continue
        if closing >= 0 and closed[end] < 0:
            if not start:
                closed[end] = 1
            else:
                pair = last[start] << PAIR_BITS | closing
                ok = young.get(pair)
                if ok is None:
                    ok = apart(pair)
                    young = merges._apart.young
                if ok:
                    closed[end] = before + 1
        if inside >= 0 and last[end] < 0:
            if not start:
                last[end], count[end] = inside, 1
            else:
                pair = last[start] << PAIR_BITS | inside
                ok = young.get(pair)
                if ok is None:
                    ok = apart(pair)
                    young = merges._apart.young
                if ok:
                    last[end], count[end] = inside, before + 1
    return closed


def trace(last: list[int], lengths: list[int]) -> list[int]:
    """The encoding of the whole text from the last piece of each prefix."""
    out, at = [], len(last) - 1
    while at > 0:
        out.append(last[at])
        at -= lengths[last[at]]
    out.reverse()
    return out


def best_pieces(auto: ahocorasick.Automaton, text: str, score: list[float], unknown: int, unknown_score: float) -> list[tuple[int, int, int]]:
    """Viterbi: (piece, start, end) of the segmentation of greatest score sum;
    a single character that no piece covers is the unknown piece. Of equal
    scores the one whose last differing piece is longest wins."""
    n = len(text)
    best, back = [0.0] + [float("-inf")] * n, [(-1, 0)] * (n + 1)
    at = 0

    def close(upto: int) -> None:
        # positions that are complete: allow the unknown character into the next one
        nonlocal at
        while at < upto:
            at += 1
            worse = best[at - 1] + unknown_score
            if worse > best[at]:
                best[at], back[at] = worse, (unknown, at - 1)

    for end, (length, x) in auto.iter(text):
        close(end)
        start, end = end + 1 - length, end + 1
        value = best[start] + score[x]
        if value > best[end]:
            best[end], back[end] = value, (x, start)
    close(n)
    out, at = [], n
    while at > 0:
        x, start = back[at]
        out.append((x, start, at))
        at = start
    out.reverse()
    return out
