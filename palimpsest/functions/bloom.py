"""Bitmaps and Bloom filters on the driver.

Runs carry Parquet's own Bloom filters, which Spark's reader uses by itself, and
:mod:`palimpsest.operators.filters` builds one over a DataFrame's keys. These
classes are for keys that a program holds and for the filters inside run files."""

from __future__ import annotations

import math

import numpy as np
import xxhash


class Bitmap:
    """A fixed number of bits in 64-bit words, little-endian when written."""

    def __init__(self, size: int, words: np.ndarray | None = None):
        if size <= 0:
            raise ValueError("a bitmap has one bit or more")
        self.size = size
        self.words = np.zeros(-(-size // 64), np.uint64) if words is None else words

    def _place(self, i: int) -> tuple[int, np.uint64]:
        if not 0 <= i < self.size:
            raise IndexError(f"bit {i} of {self.size}")
        return i // 64, np.uint64(1 << i % 64)

    def set(self, i: int) -> None:
        word, bit = self._place(i)
        self.words[word] |= bit

    def is_set(self, i: int) -> bool:
        word, bit = self._place(i)
        return bool(self.words[word] & bit)

    def to_bytes(self) -> bytes:
        return self.words.astype("<u8").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes, size: int | None = None) -> Bitmap:
        words = np.frombuffer(data, "<u8").astype(np.uint64)
        return cls(size or 64 * len(words), words)

    def __str__(self) -> str:
        return " ".join(f"{int(w):064b}" for w in self.words)


class BloomFilter:
    """Membership with no false negatives and about ``rate`` false positives for ``items`` keys."""

    def __init__(self, items: int, rate: float = 0.01, bitmap: Bitmap | None = None, hashes: int | None = None):
        if items <= 0 or not 0 < rate < 1:
            raise ValueError("items and rate have to be positive, rate under 1")
        bits = -(-math.ceil(-items * math.log(rate) / math.log(2) ** 2) // 64) * 64
        self.bitmap = bitmap or Bitmap(bits)
        self.hashes = hashes or max(1, math.ceil(self.bitmap.size / items * math.log(2)))

    def _places(self, key: bytes):
        h = xxhash.xxh3_128_intdigest(key)
        a, b = h & (1 << 64) - 1, h >> 64 | 1
        return ((a + k * b) % self.bitmap.size for k in range(self.hashes))

    def add(self, key: bytes) -> None:
        for i in self._places(key):
            self.bitmap.set(i)

    def __contains__(self, key: bytes) -> bool:
        return all(map(self.bitmap.is_set, self._places(key)))

    def to_bytes(self) -> bytes:
        return self.hashes.to_bytes(4, "little") + self.bitmap.to_bytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> BloomFilter:
        return cls(1, bitmap=Bitmap.from_bytes(data[4:]), hashes=int.from_bytes(data[:4], "little"))


#: Fixed values of the run file format: start, multiplier, and share of wrong hits.
SEED, FACTOR, RATE = 0xBC9F1D34, 0xC6A4A793, 0.01
LOW = (1 << 32) - 1


def hash32(data: bytes) -> int:
    """The 32-bit hash of run files: words of four bytes, little-endian, are added
    and mixed in turn; one to three bytes left over make a last, shorter word."""
    h = SEED ^ len(data) * FACTOR & LOW
    for at in range(0, len(data), 4):
        word = data[at : at + 4]
        h = (h + int.from_bytes(word, "little")) * FACTOR & LOW
        h ^= h >> (16 if len(word) == 4 else 24)
    return h


class RunFilter:
    """The Bloom filter inside a run file, over plain keys without their times.

    Places are made of the two halves of the hash in 16-bit arithmetic, modulo the
    low 16 bits of the filter's size. So no more than MOST_BITS are ever of use, and
    with many more than 7,000 keys the filter tells little. A size whose low bits
    are 0 has no places: such a filter, by another writer, finds every key possible."""

    MOST_BITS = 0xFFFF // 64 * 64

    def __init__(self, items: int, bitmap: Bitmap | None = None):
        if items <= 0:
            raise ValueError("a filter has one item or more")
        bits = -(-int(-items * math.log(RATE) / math.log(2) ** 2) // 64) * 64
        self.bitmap = bitmap or Bitmap(min(bits, self.MOST_BITS))
        self.turns = np.arange(math.ceil(self.bitmap.size / items * math.log(2)))

    def _places(self, key: bytes) -> np.ndarray:
        h = hash32(key)
        return ((h >> 16) + self.turns * (h & 0xFFFF | 1) & 0xFFFF) % (self.bitmap.size & 0xFFFF)

    def add(self, key: bytes) -> None:
        for i in self._places(key):
            self.bitmap.set(int(i))

    def __contains__(self, key: bytes) -> bool:
        return not self.bitmap.size & 0xFFFF or all(self.bitmap.is_set(int(i)) for i in self._places(key))
