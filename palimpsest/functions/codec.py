"""Key codecs. Column functions stay in generated code; the functions on bytes
are for file formats and single keys on the driver.

An encoded key is the key followed by its timestamp as 8 bytes, big-endian, so
that for keys of one length byte order is (key, timestamp) order."""

from __future__ import annotations

import struct
import threading
import time

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.model import KeyCodecError

TS_BYTES = 8


def _be64(x: Column) -> Column:
    return F.unhex(F.lpad(F.hex(x), 16, "0"))


def encode_key(key: Column, ts: Column) -> Column:
    """``key`` (binary) and ``ts`` (long) as an encoded key."""
    return F.concat(key, _be64(ts))


def decoded_key(encoded: Column) -> Column:
    """The key of an encoded key; null for fewer than 8 bytes."""
    n = F.length(encoded)
    return F.when(n >= TS_BYTES, F.substring(encoded, F.lit(1), n - TS_BYTES))


def decoded_ts(encoded: Column) -> Column:
    """The timestamp of an encoded key; null for fewer than 8 bytes."""
    n = F.length(encoded)
    tail = F.hex(F.substring(encoded, n - (TS_BYTES - 1), F.lit(TS_BYTES)))
    return F.when(n >= TS_BYTES, F.conv(tail, 16, -10).cast("long"))


def int_key(i: Column) -> Column:
    """An integer as 8 bytes, big-endian: negative numbers sort after others."""
    return _be64(i.cast("long"))


def str_key(s: Column) -> Column:
    return F.encode(s, "UTF-8")


def run_name(level: Column, number: Column) -> Column:
    return F.format_string("%d_%d.sst", level, number)


def encode_key_bytes(key: bytes, ts: int) -> bytes:
    return key + struct.pack(">Q", ts)


def decode_key_bytes(encoded: bytes) -> tuple[bytes, int]:
    if len(encoded) < TS_BYTES:
        raise KeyCodecError(f"an encoded key has {TS_BYTES} bytes or more, not {len(encoded)}")
    return encoded[:-TS_BYTES], struct.unpack(">Q", encoded[-TS_BYTES:])[0]


def int_key_bytes(i: int) -> bytes:
    return struct.pack(">Q", i & (1 << 64) - 1)


def little_bytes(x: int, width: int) -> bytes:
    """An unsigned integer of 16, 32 or 64 bits, little-endian."""
    return x.to_bytes(width // 8, "little")


def from_little(data: bytes) -> int:
    return int.from_bytes(data, "little")


class Clock:
    """Nanoseconds that never repeat or go back, past ``floor`` and all that was
    observed: with the manifest's time observed, past what any writer has published."""

    def __init__(self, floor: int = 0):
        self.last, self.lock = floor, threading.Lock()

    def observe(self, other: int) -> None:
        with self.lock:
            self.last = max(self.last, other)

    def now(self) -> int:
        with self.lock:
            self.last = max(time.time_ns(), self.last + 1)
            return self.last
