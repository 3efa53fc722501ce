"""Blocked Bloom filter as a table of (block, bits), built and probed with built-in functions.

A key's hash chooses one 64-bit block and ``PROBES`` bits in it, so a probe reads one block.
The number of blocks is a parameter: the filter never has more rows than that, whatever it
holds, and can be broadcast.  More keys than it was sized for only raise the share of false
positives, which an exact join has to remove anyway.
"""

from pyspark.sql import Column, DataFrame, functions as F

#: 2^18 blocks of 8 bytes: 2 MiB of bits, about 12 MB as a broadcast hash table.
BLOCKS = 1 << 18
PROBES = 4


def block_of(key: Column, blocks: int = BLOCKS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def mask_of(key: Column) -> Column:
    """The key's bits within its block, from a second hash."""
    h = F.xxhash64(key, F.lit("bits"))
    bits = F.lit(0).cast("long")
    for i in range(PROBES):
        bits = bits.bitwiseOR(_bit(h, 6 * i))
    return bits


def _bit(h: Column, shift: int) -> Column:
    place = F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(63)).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("long"), place)


def build(keys: DataFrame, key: str, blocks: int = BLOCKS) -> DataFrame:
    """The filter of a column's values: at most ``blocks`` rows; nulls are left out."""
    some = keys.where(F.col(key).isNotNull())
    return (
        some.select(block_of(F.col(key), blocks).alias("bloom_block"), mask_of(F.col(key)).alias("m"))
        .groupBy("bloom_block")
        .agg(F.bit_or("m").alias("bloom_bits"))
    )


def possible(rows: DataFrame, key: str, bloom: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """Rows whose key may be in the filter; never loses one that is."""
    probe = rows.withColumns({"bloom_at": block_of(F.col(key), blocks), "bloom_mask": mask_of(F.col(key))})
    hit = (F.col("bloom_at") == F.col("bloom_block")) & (
        F.col("bloom_bits").bitwiseAND(F.col("bloom_mask")) == F.col("bloom_mask")
    )
    return probe.join(F.broadcast(bloom), hit, "left_semi").drop("bloom_at", "bloom_mask")
