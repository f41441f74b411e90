"""Deterministic samples of collections, and the tables of a run restricted to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from basketry.functions.hashing import hash_score
from basketry.operators.splits import INTERACTION

SORTED_SAMPLE = 100_000


def sample_collections(
    rows: DataFrame,
    split_name: str,
    sample_size: int | None,
    seed: int = 42,
    hash_fn: str = "xxhash64",
    sorted_sample: int = SORTED_SAMPLE,
) -> DataFrame:
    """The ``sample_size`` distinct pids with the lowest hash score, ties by pid; all of them for ``None``.

    A small sample is a top-n. A sample beyond ``sorted_sample`` pids would put all of them through one task,
    so the score to stop at is read off the histogram of scores, and only the pids at that score are ordered.
    """
    pids = rows.select("pid").distinct()
    if sample_size is None:
        return pids
    scored = pids.withColumn("score", hash_score(seed, F.lit(split_name), "pid", hash_fn=hash_fn))
    if sample_size <= sorted_sample:
        return scored.orderBy("score", "pid").limit(sample_size).select("pid")

    # One row per distinct score, of which there are at most a million.
    running = Window.orderBy("score").rowsBetween(Window.unboundedPreceding, 0)
    histogram = (
        scored.groupBy("score")
        .agg(F.count(F.lit(1)).alias("pids"))
        .withColumn("room", F.lit(sample_size) - F.sum("pids").over(running) + F.col("pids"))
        .where(F.col("room") > 0)
    )
    kept = scored.join(F.broadcast(histogram), "score")
    whole = kept.where(F.col("pids") <= F.col("room"))
    partial = kept.where(F.col("pids") > F.col("room")).withColumn(
        "n", F.row_number().over(Window.partitionBy("score").orderBy("pid"))
    )
    return whole.select("pid").unionByName(partial.where(F.col("n") <= F.col("room")).select("pid"))


def restrict_run_tables(
    train: DataFrame,
    context: DataFrame,
    targets: DataFrame,
    train_sample_size: int | None = 50_000,
    validation_sample_size: int | None = 5_000,
    seed: int = 42,
    hash_fn: str = "xxhash64",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Train, context and targets of the sampled collections, without null items.

    Context and targets share one sample, drawn from the context. Without a sample size every collection of
    the table it would be drawn from stays.
    """

    def known(rows: DataFrame) -> DataFrame:
        return rows.where(F.col("track_id").isNotNull()).select(*INTERACTION)

    def members(rows: DataFrame, of: DataFrame, name: str, size: int | None) -> DataFrame:
        if size is None and rows is of:
            return rows.where(F.col("pid").isNotNull())
        return rows.join(sample_collections(of, name, size, seed, hash_fn), "pid", "left_semi")

    return (
        known(members(train, train, "train", train_sample_size)),
        known(members(context, context, "validation", validation_sample_size)),
        known(members(targets, context, "validation", validation_sample_size)),
    )
