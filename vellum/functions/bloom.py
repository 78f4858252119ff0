"""A Bloom filter as plain expressions: built by a map-side combined bit_or, probed inside codegen.

The filter is one row with an array of 64-bit words. It enters a plan as an uncorrelated scalar subquery, so that it is
computed once, sent to the tasks with the plan, and probed without a join. Its size is fixed by log2_bits, whatever the
number of keys; with more keys than it suits, fewer orphans are proven and more references go to the exact join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HASHES = 4
#: 2**26 bits, 8 MB: the proven bound of what is broadcast.
MAX_LOG2_BITS = 26
MIN_LOG2_BITS = 14


def log2_bits_for(keys: int) -> int:
    """About 16 bits a key between the bounds: with 4 hashes, one absent key in 400 passes."""
    return min(MAX_LOG2_BITS, max(MIN_LOG2_BITS, (16 * max(keys, 1) - 1).bit_length()))


def _positions(key: Column, log2_bits: int) -> list[Column]:
    return [F.xxhash64(F.lit(i), key).bitwiseAND(F.lit((1 << log2_bits) - 1)) for i in range(HASHES)]


def build(keys: DataFrame, key: str, log2_bits: int) -> DataFrame:
    """One row, one column: the words of the filter. keys is read once; the shuffle carries at most a row a word and task."""
    bits = keys.filter(F.col(key).isNotNull()).select(F.explode(F.array(*_positions(F.col(key), log2_bits))).alias("p"))
    bits = bits.select(F.shiftright("p", 6).alias("w"), F.expr("shiftleft(1L, cast(p & 63 AS int))").alias("b"))
    blank = keys.sparkSession.range(1 << (log2_bits - 6)).select(F.col("id").alias("w"), F.lit(0).cast("bigint").alias("b"))
    words = bits.unionByName(blank).groupBy("w").agg(F.bit_or("b").alias("b"))
    return words.agg(F.array_sort(F.collect_list(F.struct("w", "b"))).alias("s")).select(F.col("s.b").alias("words"))


def probe(df: DataFrame, words: DataFrame, key: str, log2_bits: int, out: str) -> DataFrame:
    """df with a column out; where that is false, key is certainly not among the keys of the filter."""
    # the words become a column first, as a subquery may not stand in a lambda; the one-element array binds them to a
    # variable, so that the plan holds the subquery once and not once a hash
    positions = _positions(F.col(key), log2_bits)

    def test(hit: Column, w: Column) -> Column:
        for p in positions:
            hit = hit & (F.getbit(F.get(w, F.shiftright(p, 6).cast("int")), p.bitwiseAND(F.lit(63)).cast("int")) == 1)
        return hit

    held = df.select("*", words.scalar().alias("_words"))
    return held.select(*df.columns, F.aggregate(F.array("_words"), F.lit(True), test).alias(out))
