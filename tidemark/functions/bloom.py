"""Blocked Bloom filters as tables: a row of eight 32-bit words for each block; a key sets one bit in each word of its block."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS, WORD_BITS = 8, 32


def _bits(key: str) -> list[Column]:
    h = F.xxhash64(F.col(key), F.lit(1))
    return [F.shiftright(h, 5 * i).bitwiseAND(F.lit(WORD_BITS - 1)).cast("int") for i in range(WORDS)]


def _block(key: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def filter_of(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """(block, w0 .. w7) of the keys, repeated ones included."""
    return keys.groupBy(_block(key, blocks).alias("block")).agg(*[F.bit_or(F.call_function("shiftleft", F.lit(1), bit)).alias(f"w{i}") for i, bit in enumerate(_bits(key))])


def together(filters: DataFrame) -> DataFrame:
    """One filter of what several of the same number of blocks hold."""
    return filters.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])


def may_hold(rows: DataFrame, held: DataFrame, key: str, blocks: int) -> DataFrame:
    """rows with `possible`: false only where the filter proves that it doesn't hold the key. Mark `held` for broadcast where it is small."""
    words = [f"w{i}" for i in range(WORDS)]
    met = rows.withColumn("block", _block(key, blocks)).join(held, "block", "left")
    all_set = reduce(lambda a, b: a & b, [F.call_function("shiftright", F.col(w), bit).bitwiseAND(F.lit(1)) == 1 for w, bit in zip(words, _bits(key), strict=True)])
    return met.withColumn("possible", F.coalesce(all_set, F.lit(False))).drop("block", *words)
