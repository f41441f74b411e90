"""Exact duplicates: rows grouped by a 128-bit content hash, their bytes compared inside each group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from basketry.llm.common import fresh_names, whole
from basketry.sources.tables import save_table, scratch_root


def md5_bytes(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def exact_duplicates(
    docs: DataFrame,
    keep: str = "smallest",
    id_col: str = "doc_id",
    text_col: str = "text",
    content_hash: Callable[[Column], Column] = md5_bytes,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when their bytes are equal; null counts as the empty text. Of equal texts the smallest (or
    ``keep="largest"``) id stays. A null id never stays if the group has another; alone it stays, with a null
    ``keep_id``. Repeated rows with one id and one text all count in ``group_size`` and share one verdict. An empty
    table gives an empty result; other columns of ``docs`` are not read.

    Only hashes and counts meet in the grouping, combined before the shuffle. Then each row of a group of several
    is compared with the text that stays, by a join of one text per group, whose hot groups Spark splits. A row
    whose bytes differ (a collision of the hash) carries its own text as part of the key of its class.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep: smallest or largest, not {keep!r}")
    extreme = F.min if keep == "smallest" else F.max
    root = scratch_root(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text")).withColumn("hash", content_hash(F.col("text")))
    groups = rows.groupBy("hash").agg(extreme("id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    sized = (
        rows.withColumn("sha", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
        .join(groups, "hash")
        .select("id", "hash", "sha", "keep_id", "n", F.when(F.col("n") > 1, F.col("text")).alias("text"))
    )
    sized = save_table(sized, root, "sized")
    several = sized.where(F.col("n") > 1)
    staying = several.where(F.col("id").eqNullSafe(F.col("keep_id"))).groupBy("hash").agg(F.min("text").alias("stays"))
    compared = several.join(staying, "hash").select(
        "id", "hash", "sha", F.when(F.col("text") != F.col("stays"), F.col("text")).alias("other")
    )
    compared = save_table(compared, root, "compared")
    classes = compared.groupBy("hash", "other").agg(extreme("id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    classes = classes.withColumnsRenamed({"hash": "class_hash", "other": "class_other"})
    same_class = (F.col("hash") == F.col("class_hash")) & F.col("other").eqNullSafe(F.col("class_other"))
    alone = sized.where(F.col("n") == 1).select("id", "keep_id", "n", "sha")
    return alone.union(compared.join(classes, same_class).select("id", "keep_id", "n", "sha")).select(
        F.col("id").alias("doc_id"),
        "keep_id",
        F.col("n").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, keep: str = "smallest", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one for each distinct text, with all their columns, whatever the names of these.

    Which row stays, and what nulls, empty texts and ids that repeat mean, is told by :func:`exact_duplicates`. Of rows
    that share the staying id and text any one stays, whole. An empty table gives an empty result.
    """
    sha, stays, stays_sha = fresh_names(docs, 3)
    found = exact_duplicates(docs, keep, id_col, text_col).where("kept")
    staying = found.select(F.col("doc_id").alias(stays), F.unhex("text_sha256").alias(stays_sha)).distinct()
    keyed = docs.withColumn(sha, F.unhex(F.sha2(whole(text_col).cast("binary"), 256)))
    same = F.col(id_col).eqNullSafe(F.col(stays)) & (F.col(sha) == F.col(stays_sha))
    return keyed.join(staying, same, "left_semi").dropDuplicates([id_col, sha]).drop(sha)
