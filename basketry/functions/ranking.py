"""Exact ``row_number`` for groups too large for one task.

A plain window ranks each group inside one task. For groups of any size the rows are dealt over ranges of the order
instead, numbered where they lie, and shifted by the sizes of the earlier ranges.
"""

from __future__ import annotations

from collections.abc import Sequence
from uuid import uuid4

from pyspark.sql import Column, DataFrame, Window, functions as F

from basketry.sources.tables import save_table, scratch_root

GIANT_ROWS = 1_000_000


def shuffle_tasks(frame: DataFrame) -> int:
    """Partitions of a shuffle whose number is to be told: ``spark.sql.shuffle.partitions``."""
    return int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def same_keys(left: Sequence[str], right: Sequence[str]) -> Column:
    """Whether all keys agree; nulls agree with nulls."""
    same = F.lit(True)
    for a, b in zip(left, right, strict=True):
        same &= F.col(a).eqNullSafe(F.col(b))
    return same


def range_rank(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], into: str, root: str | None = None) -> DataFrame:
    """1-based position inside each group of ``keys`` in the total ``order``, as a bigint, whatever the groups' sizes.

    The rows are dealt over ranges of (keys, order), so a group of any size lies in as many partitions as its share
    of the rows asks for. They are written once, sorted, each with its place in its partition. A group's rows in one
    partition are consecutive, so all that remains is an offset for each (group, partition), of which there are no
    more than groups and partitions together. No list of cuts is gathered, and no row is ranked by a window.
    Null keys are a group. Rows that tie on the whole order are ranked in any order.
    """
    by = [*(F.col(k) for k in keys), *order]
    dealt = rows.repartitionByRange(shuffle_tasks(rows), *by).sortWithinPartitions(*by)
    placed = dealt.withColumn("__at", F.monotonically_increasing_id())
    placed = save_table(placed, root or scratch_root(rows.sparkSession), f"placed-{uuid4().hex}")
    placed = placed.withColumn("__part", F.shiftright("__at", 33))
    own = [f"__key{i}" for i in range(len(keys))]
    earlier = Window.partitionBy(*own).orderBy("__of").rowsBetween(Window.unboundedPreceding, -1)
    runs = (
        placed.groupBy(*(F.col(k).alias(o) for k, o in zip(keys, own)), F.col("__part").alias("__of"))
        .agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__rows"))
        .withColumn("__shift", F.coalesce(F.sum("__rows").over(earlier), F.lit(0)) - F.col("__first") + 1)
    )
    if not keys:
        runs = F.broadcast(runs)  # a row for each partition
    found = placed.join(runs, (F.col("__part") == F.col("__of")) & same_keys(keys, own))
    return found.select(*rows.columns, (F.col("__at") + F.col("__shift")).alias(into))


def group_rank(
    rows: DataFrame, keys: Sequence[str], order: Sequence[Column], into: str, giants: DataFrame | None, root: str | None = None
) -> DataFrame:
    """1-based position inside each group of ``keys`` in the ascending ``order``, as a bigint.

    Groups whose keys are in the written table ``giants`` are ranked by :func:`range_rank`, the others by a window.
    Spark knows the size of a written table: it broadcasts a small one and divides hot keys of a join with a large one.
    """
    by_window = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint")
    if giants is None or giants.isEmpty():
        return rows.withColumn(into, by_window)
    own = [f"__giant{i}" for i in range(len(keys))]
    named = giants.select(*(F.col(k).alias(o) for k, o in zip(keys, own)))
    same = same_keys(keys, own)
    large = rows.join(named, same, "left_semi")
    return rows.join(named, same, "left_anti").withColumn(into, by_window).unionByName(range_rank(large, keys, order, into, root))
