"""A filter of fixed size before a join with few of its keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# 2**25 bits: half a million rows of 64 bits are broadcast at most, at any data size.
FILTER_BITS = 25


def maybe_in(rows: DataFrame, key: str, of: DataFrame, of_key: str, bits: int = FILTER_BITS) -> DataFrame:
    """The ``rows`` whose ``key`` may be among the keys of ``of``: all that are, and few others.

    For a join that drops most rows but is too large to broadcast: what it would drop need not be shuffled. The keys of
    ``of`` are marked in a bitmap. When they outnumber the bits, all rows pass and the join alone decides. Both keys
    are of one type; null is no key.
    """

    def slot(column: str) -> Column:
        return F.xxhash64(column).bitwiseAND(F.lit((1 << bits) - 1))

    marks = of.where(F.col(of_key).isNotNull()).select(slot(of_key).alias("__slot"))
    word, bit = F.shiftright("__slot", 6), F.col("__slot").bitwiseAND(F.lit(63)).cast("int")
    words = marks.groupBy(word.alias("__word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)).alias("__bits"))
    marked = rows.where(F.col(key).isNotNull()).withColumn("__slot", slot(key)).withColumn("__of", F.shiftright("__slot", 6))
    found = marked.join(F.broadcast(words), F.col("__of") == F.col("__word")).where(F.getbit("__bits", bit) == 1)
    return found.select(*rows.columns)
