"""A blocked Bloom filter as a table: it stands in front of dictionaries too large to broadcast.

Each phrase sets one bit in each of eight 64-bit words of its block.  A block is sized for 32 phrases, so the number of blocks
follows the counted dictionary and the share of false hits stays near 0.1 % whatever its size.  The blocks are built by a
grouped aggregation and joined by their number: nothing passes through the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 8
PHRASES_PER_BLOCK = 32
#: Memory of a block in a broadcast relation, generously.
BLOCK_BYTES = 160


def block_count(phrases: int) -> int:
    """Blocks for a counted number of phrases."""
    return max(1, math.ceil(phrases / PHRASES_PER_BLOCK))


def _block(phrase: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(phrase, F.lit(17)), F.lit(blocks))


def _places(phrase: Column) -> Column:
    return F.xxhash64(phrase, F.lit(29))


def _place(places: Column, word: int) -> Column:
    return F.shiftright(places, 6 * word).bitwiseAND(63).cast("int")


def build(phrases: DataFrame, blocks: int) -> DataFrame:
    """(block, w0..w7) of a table with a column ``phrase``."""
    rows = phrases.select(_block(F.col("phrase"), blocks).alias("block"), _places(F.col("phrase")).alias("places"))
    mask = [F.call_function("shiftleft", F.lit(1).cast("long"), _place(F.col("places"), i)) for i in range(WORDS)]
    return rows.groupBy("block").agg(*[F.bit_or(m).alias(f"w{i}") for i, m in enumerate(mask)])


def likely(rows: DataFrame, bloom: DataFrame, blocks: int) -> DataFrame:
    """The rows whose ``phrase`` passes; ``bloom`` is broadcast, so its size must have been checked."""
    probed = rows.withColumn("block", _block(F.col("phrase"), blocks)).withColumn("places", _places(F.col("phrase")))
    hit = F.lit(True)
    for i in range(WORDS):
        hit = hit & (F.getbit(f"w{i}", _place(F.col("places"), i)) == 1)
    return probed.join(F.broadcast(bloom), "block").where(hit).select(*rows.columns)
