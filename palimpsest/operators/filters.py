"""A Bloom filter over a DataFrame's keys, built and asked in generated code.

The filter is a table of blocks of 4 KiB. A key's hash names its block and the
bits in it, so a block is one aggregate and a lookup is one join. It is sent to
every task only if the number of keys proves it small enough."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_BITS = 32_768
#: Bits and hashes a key: about 0.5% wrong hits.
KEY_BITS, HASHES = 12, 6
#: Most bytes of blocks that are sent to every task.
MOST_BYTES = 64 << 20


def blocks_for(n_keys: int) -> int:
    return max(1, -(-n_keys * KEY_BITS // BLOCK_BITS))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _bits(key: Column) -> list[Column]:
    h = F.xxhash64(F.lit("bits"), key)
    first, step = F.shiftrightunsigned(h, 32), h.bitwiseAND(F.lit(0x7FFFFFFF)).bitwiseOR(F.lit(1))
    return [(first + F.lit(i) * step) % BLOCK_BITS for i in range(HASHES)]


def bloom_blocks(keys: DataFrame, blocks: int) -> DataFrame:
    """(block, bits) over the non-null keys of a DataFrame (key)."""
    rows = keys.filter("key IS NOT NULL").select(_block(F.col("key"), blocks).alias("block"), F.explode(F.array(*_bits(F.col("key")))).alias("bit"))
    return rows.groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits"))


def might_contain(rows: DataFrame, filters: DataFrame, blocks: int, key: str = "key") -> DataFrame:
    """The rows whose key may be among the filter's: all that are, few that are not."""
    own = rows.withColumn("_block", _block(F.col(key), blocks)).join(F.broadcast(filters), F.col("_block") == F.col("block"))
    hit, masks = F.lit(True), F.array(*[F.lit(1 << k) for k in range(8)])
    for bit in _bits(F.col(key)):
        byte = F.ascii(F.decode(F.substring("bits", F.shiftright(bit, 3).cast("int") + 1, F.lit(1)), "ISO-8859-1"))
        hit = hit & (byte.bitwiseAND(F.element_at(masks, (bit % 8 + 1).cast("int"))) != 0)
    return own.filter(hit).select(*rows.columns)


def bloom_semi(rows: DataFrame, keys: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Rows whose key is among ``keys`` (key). What the filter lets pass meets the
    keys in an exact semi-join, so that few other rows are shuffled. More keys than
    a filter of ``most_bytes`` is for are joined without one."""
    blocks = blocks_for(keys.count())
    if blocks * BLOCK_BITS // 8 <= most_bytes:
        rows = might_contain(rows, bloom_blocks(keys, blocks), blocks)
    return rows.join(keys.select("key").distinct(), "key", "left_semi")
