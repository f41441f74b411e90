"""Recall, Precision and NDCG of recommendations against the hidden items."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from basketry.functions.checks import validate_ks

BASELINES = ("popularity", "cooccurrence")
METRICS = ("recall", "precision", "ndcg")
# Shares and gains are summed as whole numbers of this part of one, so that no result depends on the order of addition.
UNITS = 1e12


def _k_list(ks: Sequence[int]) -> Column:
    return F.array(*[F.lit(k) for k in validate_ks(ks)])


def _units(share: Column) -> Column:
    """A number as a whole number of units, rounded half up."""
    return F.round(share * F.lit(UNITS)).cast("decimal(20,0)")


def _of_units(units: Column) -> Column:
    return units.cast("double") / F.lit(UNITS)


def _gain(rank: Column) -> Column:
    return _units(F.lit(1.0) / F.log2(rank + F.lit(1)))


def ideal_dcg(target_count: Column | str, k: Column | str) -> Column:
    """DCG of a perfect list: the gains of ranks 1 to the smaller of ``target_count`` and ``k``."""
    count, cutoff = (F.col(c) if isinstance(c, str) else c for c in (target_count, k))
    best = F.least(count.cast("int"), cutoff.cast("int"))
    ranks = F.when(best > 0, F.sequence(F.lit(1), best)).otherwise(F.array().cast("array<int>"))
    none = F.lit(0).cast("decimal(30,0)")
    return _of_units(F.aggregate(ranks, none, lambda total, rank: (total + _gain(rank)).cast("decimal(30,0)")))


def relevant_items(targets: DataFrame) -> DataFrame:
    return targets.select("pid", "track_id").distinct()


def target_counts(targets: DataFrame) -> DataFrame:
    return relevant_items(targets).groupBy("pid").agg(F.count(F.lit(1)).alias("target_count"))


def hits_and_dcg(recommendations: DataFrame, targets: DataFrame, ks: Sequence[int]) -> DataFrame:
    """``baseline_name, pid, k, hit_count, dcg`` for every collection with recommendations, in one pass."""
    hit = relevant_items(targets).withColumn("hit", F.lit(1))
    judged = recommendations.select("baseline_name", "pid", "rank", "track_id").join(hit, ["pid", "track_id"], "left")

    def within(k: int) -> Column:
        listed = F.col("rank") <= k
        found = listed & F.col("hit").isNotNull()
        return F.struct(
            F.lit(k).alias("k"),
            F.count_if(listed).alias("listed"),
            F.count_if(found).cast("double").alias("hit_count"),
            _of_units(F.coalesce(F.sum(F.when(found, _gain(F.col("rank")))), F.lit(0))).alias("dcg"),
        )

    return (
        judged.groupBy("baseline_name", "pid")
        .agg(F.array(*[within(k) for k in validate_ks(ks)]).alias("cutoffs"))
        .select("baseline_name", "pid", F.inline("cutoffs"))
        .where(F.col("listed") > 0)
        .drop("listed")
    )


def ranking_metrics(
    recommendations: DataFrame,
    targets: DataFrame,
    ks: Sequence[int],
    baselines: Sequence[str] = BASELINES,
) -> DataFrame:
    """``baseline_name, k, recall, precision, ndcg``, averaged over every collection that has targets.

    A collection without a hit adds zero to each sum, so only the hits are aggregated and the number of
    collections divides the sums at the end. A recommender without any row still scores 0.
    """
    # Recommendations that hit: for those without, hits_and_dcg would give zeros.
    hitting = recommendations.join(relevant_items(targets), ["pid", "track_id"], "left_semi")
    hits = hits_and_dcg(hitting, targets, ks)
    counts = target_counts(targets)
    sums = (
        hits.join(counts, "pid")
        .groupBy("baseline_name", "k")
        .agg(
            F.sum(_units(F.col("hit_count") / F.col("target_count"))).alias("recall"),
            F.sum(_units(F.col("hit_count") / F.col("k"))).alias("precision"),
            F.sum(_units(F.col("dcg") / ideal_dcg("target_count", "k"))).alias("ndcg"),
        )
    )
    asked = (
        counts.agg(F.count(F.lit(1)).alias("collections"))
        .where(F.col("collections") > 0)
        .select("collections", F.explode(F.array(*[F.lit(b) for b in baselines])).alias("baseline_name"))
        .select("collections", "baseline_name", F.explode(_k_list(ks)).alias("k"))
    )
    # One row per recommender and cutoff.
    return asked.join(F.broadcast(sums), ["baseline_name", "k"], "left").select(
        "baseline_name",
        "k",
        *[(F.coalesce(m, F.lit(0)).cast("double") / (F.col("collections") * F.lit(UNITS))).alias(m) for m in METRICS],
    )


# How the report names the metrics.
REPORT_NAMES = {"recall": "Recall", "precision": "Precision", "ndcg": "NDCG"}


def metrics_report(metrics: DataFrame) -> DataFrame:
    """One row ``baselines``: recommender -> ``Recall@k`` ... -> value, keys sorted."""
    named = metrics.select(
        "baseline_name",
        F.inline(
            F.array(
                *[
                    F.struct(F.concat(F.lit(f"{label}@"), F.col("k").cast("string")).alias("metric"), F.col(m).alias("value"))
                    for m, label in REPORT_NAMES.items()
                ]
            )
        ),
    )
    per_baseline = named.groupBy("baseline_name").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("metric", "value")))).alias("values")
    )
    return per_baseline.agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("baseline_name", "values")), lambda a, b: F.when(a["baseline_name"] < b["baseline_name"], -1).otherwise(1))).alias("baselines")
    )


def report_json(metrics: DataFrame) -> str:
    """The report as one JSON document: keys sorted, two blanks a level. ``metrics`` has a row per recommender and cutoff."""
    return json.dumps({"baselines": metrics_report(metrics).first().baselines or {}}, indent=2, sort_keys=True)
