"""Item popularity, lookups into it, and the popularity recommender."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from basketry.functions.ranking import range_rank

# Rows of the popularity table that are broadcast: a fixed number of short rows at any data size. They hold
# the most frequent items, so every item with a large share of the rows is among them.
HEAD_ITEMS = 50_000
# Items beyond max_k + the largest context that stay in the candidate pool; fixed value.
POOL_SLACK = 50
# Popularity ranks per block of :func:`recommend_popular`.
BLOCK_RANKS = 1024

RECOMMENDATION = ("baseline_name", "pid", "rank", "track_id", "score")


def item_popularity(train: DataFrame, root: str | None = None) -> DataFrame:
    """``track_id, train_frequency, popularity_rank``: occurrences per item, ranked by them, ties by id.

    The items are dealt over ranges of (frequency, id), so no task sees all of them or all of one frequency, however
    many items share it. The table between the two steps lies in ``root``, or in a scratch folder.
    """
    frequency = train.groupBy("track_id").agg(F.count(F.lit(1)).alias("train_frequency"))
    return range_rank(frequency, [], [F.desc("train_frequency"), F.col("track_id")], "popularity_rank", root)


def fits_head(items: DataFrame, head_items: int) -> bool:
    """Whether a table is no larger than a head; of a written table that is read off its files' footers."""
    return items.limit(head_items + 1).count() <= head_items


def with_popularity(rows: DataFrame, popularity: DataFrame, head_items: int = HEAD_ITEMS) -> DataFrame:
    """``rows`` left-joined with frequency and rank by ``track_id``.

    Frequent items meet the broadcast head; what remains has no hot key and is joined by shuffle. A table that is no
    larger than the head is all head.
    """
    if fits_head(popularity, head_items):
        return rows.join(F.broadcast(popularity), "track_id", "left")
    near = rows.join(F.broadcast(popularity.where(F.col("popularity_rank") <= head_items)), "track_id", "left")
    found = F.col("popularity_rank").isNotNull()
    tail = popularity.where(F.col("popularity_rank") > head_items)
    far = near.where(~found).select(*rows.columns).join(tail, "track_id", "left")
    return near.where(found).unionByName(far)


def by_rank(rows: DataFrame, rank: str, popularity: DataFrame, head_items: int = HEAD_ITEMS) -> DataFrame:
    """``rows`` joined with the items at popularity rank ``rank``, broadcast head and shuffled tail as above."""
    items = popularity.withColumnRenamed("popularity_rank", rank)
    if fits_head(items, head_items):
        return rows.join(F.broadcast(items), rank)
    in_head = F.col(rank) <= head_items
    head = rows.where(in_head).join(F.broadcast(items.where(in_head)), rank)
    return head.unionByName(rows.where(~in_head).join(items.where(~in_head), rank))


def popularity_candidates(context: DataFrame, popularity: DataFrame, max_k: int) -> DataFrame:
    """The most popular items, as many as leave ``max_k`` unseen ones to every collection."""
    largest = (
        context.select("pid", "track_id")
        .distinct()
        .groupBy("pid")
        .agg(F.count(F.lit(1)).alias("items"))
        .agg(F.coalesce(F.max("items"), F.lit(0)))
    )
    return popularity.where(F.col("popularity_rank") <= F.lit(max_k + POOL_SLACK) + largest.scalar())


def recommend_popular(
    context: DataFrame,
    popularity: DataFrame,
    max_k: int,
    block_ranks: int = BLOCK_RANKS,
    head_items: int = HEAD_ITEMS,
) -> DataFrame:
    """Per collection the ``max_k`` most popular items that are not in its context.

    No candidate pool is paired with the collections. The popularity ranks a collection has seen are sorted,
    and the unseen ranks are the gaps between them: with i seen ranks before it, gap rank p is recommendation
    number p - i. The seen ranks are held in blocks of ``block_ranks``, so a collection of any size is spread
    over rows of bounded length, and only blocks that can still contribute a gap are opened.
    """
    seen = with_popularity(context.select("pid", "track_id"), popularity, head_items)
    # A collection that has seen nothing popular keeps one block with no ranks.
    blocks = (
        seen.select("pid", F.col("popularity_rank").alias("seen_rank"))
        .withColumn("block", F.floor(F.coalesce("seen_rank", F.lit(0)) / F.lit(block_ranks)))
        .groupBy("pid", "block")
        .agg(F.sort_array(F.collect_set("seen_rank")).alias("ranks"))
    )

    in_order = Window.partitionBy("pid").orderBy("block")
    outline = (
        blocks.select("pid", "block", F.size("ranks").alias("items"), F.get("ranks", 0).alias("lowest"))
        .withColumn("next_seen", F.lead("lowest").over(in_order))
        .withColumn(
            "seen_before",
            F.coalesce(F.sum("items").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        )
        .withColumn("is_first", F.row_number().over(in_order) == 1)
    )
    # Ranks below the block that the collection has not seen; from max_k on, the list is already full. The first
    # block is always opened, as the gap below it starts from there.
    unseen_before = F.greatest(F.col("block") * block_ranks - 1, F.lit(0)) - F.col("seen_before")
    next_rank = F.col("block") * block_ranks + F.col("items")
    is_solid = (F.col("lowest") == F.col("block") * block_ranks) & (F.col("next_seen") == next_rank)
    contributes = (unseen_before < max_k) & ~F.coalesce(is_solid, F.lit(False))
    opened = outline.where(F.col("is_first") | contributes)

    # "Rank 0" stands before the first seen rank of the collection, so that the gap from rank 1 has a start.
    starts = F.when(
        F.col("is_first"), F.concat(F.array(F.lit(0).cast("bigint")), F.col("ranks"))
    ).otherwise(F.col("ranks"))
    seen_up_to = F.col("seen_before") + F.when(F.col("is_first"), 0).otherwise(1)

    def gap(start, index):
        seen_so_far = seen_up_to + index
        following = F.coalesce(F.get("starts", index + 1), F.col("next_seen"))
        return F.struct(
            (start - seen_so_far + 1).alias("first"),
            F.least(F.lit(max_k), F.coalesce(following - seen_so_far - 1, F.lit(max_k))).alias("last"),
            seen_so_far.alias("shift"),
        )

    gaps = (
        opened.join(blocks.select("pid", "block", "ranks"), ["pid", "block"])
        .withColumn("starts", starts)
        .select("pid", F.inline(F.filter(F.transform("starts", gap), lambda g: g["first"] <= g["last"])))
    )
    wanted = gaps.select("pid", "shift", F.explode(F.sequence("first", "last")).alias("rank")).select(
        "pid", F.col("rank").cast("int").alias("rank"), (F.col("rank") + F.col("shift")).alias("at_rank")
    )
    return by_rank(wanted, "at_rank", popularity, head_items).select(
        F.lit("popularity").alias("baseline_name"),
        "pid",
        "rank",
        "track_id",
        F.col("train_frequency").cast("double").alias("score"),
    )
