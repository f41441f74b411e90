"""What a run read, kept and left out, as one-row tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from basketry.operators.flatten import is_interaction
from basketry.operators.splits import EVALUATION


def ingest_summary(documents: DataFrame) -> DataFrame:
    """Files, unreadable files, collections and interactions of :func:`read_documents` rows.

    ``dropped_interactions`` are occurrences without a pid, a usable position or a URI.
    """

    def total(condition: Callable[[Column, Column], Column]) -> Column:
        """Occurrences of a document for which ``condition`` of collection and item holds."""

        def add(sum_: Column, c: Column) -> Column:
            return sum_ + F.size(F.filter(c["tracks"], lambda item: condition(c, item)))

        with_items = F.filter("playlists", lambda c: c["tracks"].isNotNull())
        return F.coalesce(F.aggregate(with_items, F.lit(0).cast("bigint"), add), F.lit(0))

    per_document = documents.select(
        "source_file",
        F.col("unreadable").cast("int").alias("corrupt"),
        F.coalesce(F.size(F.filter("playlists", lambda c: c.isNotNull())), F.lit(0)).alias("collections"),
        total(lambda c, item: F.lit(True)).alias("occurrences"),
        total(lambda c, item: ~is_interaction(c["pid"], item)).alias("dropped"),
    )
    return per_document.agg(
        F.count_distinct("source_file").alias("input_file_count"),
        F.coalesce(F.sum("corrupt"), F.lit(0)).alias("corrupt_files"),
        F.coalesce(F.sum("collections"), F.lit(0)).alias("playlists_read"),
        F.coalesce(F.sum("occurrences"), F.lit(0)).alias("items_read"),
        F.coalesce(F.sum("dropped"), F.lit(0)).alias("dropped_interactions"),
    )


def split_summary(splits: DataFrame) -> DataFrame:
    """Collections per label, and how many are held out for evaluation."""

    def labelled(*names: str) -> Column:
        return F.count_if(F.col("split").isin(*names))

    return splits.agg(
        labelled("train").alias("train_playlists"),
        labelled("validation").alias("validation_playlists"),
        labelled("test").alias("test_playlists"),
        labelled(*EVALUATION).alias("eligible_eval_playlists"),
    )


def run_summary(train: DataFrame, context: DataFrame, full_data: bool) -> DataFrame:
    """Collections a recommendation run used, and whether it used all."""
    train_pids = train.agg(F.count_distinct("pid").alias("sampled_train_playlists"))
    context_pids = context.agg(F.count_distinct("pid"))
    return train_pids.select(
        F.lit(full_data).alias("full_data_mode"),
        "sampled_train_playlists",
        context_pids.scalar().alias("sampled_validation_playlists"),
    )
