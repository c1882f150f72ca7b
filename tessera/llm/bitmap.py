"""A bitmap of fixed size over hashed keys, built and probed with SQL functions.

It is a filter only: a clear bit proves that a key is absent, a set bit asks for
the exact join. Its size is a parameter and does not depend on the data, so
broadcasting it is safe; with more keys it fills up and lets more rows through
to the exact join, which stays right.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits in one block of the built-in bitmap functions.
BLOCK = 32768


def position(key: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(bits).cast("long"))


def block_of(at: Column) -> Column:
    return F.floor(at / BLOCK)


def bit_in_block(at: Column) -> Column:
    return at % BLOCK


def bit_is_set(bitmap: Column, at: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (at % 8).cast("int")) == 1


def build(df: DataFrame, key: Column, bits: int) -> DataFrame:
    """``(block, bitmap)``, at most ``bits / 32768`` rows of 4 KB."""
    at = position(key, bits)
    return (
        df.select(block_of(at).alias("block"), bit_in_block(at).alias("bit"))
        .groupBy("block")
        .agg(F.bitmap_construct_agg("bit").alias("bitmap"))
    )


def probe(df: DataFrame, key: Column, bitmap: DataFrame, bits: int, flag: str) -> DataFrame:
    """``df`` with ``flag``: false if the key is certainly not among those of the bitmap."""
    own, blocks = f"{flag}_at", bitmap.select(F.col("block").alias(f"{flag}_block"), F.col("bitmap").alias(f"{flag}_bitmap"))
    placed = df.withColumn(own, position(key, bits))
    joined = placed.join(F.broadcast(blocks), block_of(F.col(own)) == F.col(f"{flag}_block"), "left")
    hit = F.coalesce(bit_is_set(F.col(f"{flag}_bitmap"), bit_in_block(F.col(own))), F.lit(False))
    return joined.withColumn(flag, hit).drop(own, f"{flag}_block", f"{flag}_bitmap")
