"""What the physical plans must and must not contain."""

import pytest
from pyspark.sql import functions as F

from basketry.operators import (
    SplitSpec, cooccurrence_pairs, hidden_rows, holdout_rank, holdout_targets, item_popularity, ranking_metrics, recommend_cooccurrence,
    recommend_popular, visible_part, visible_rows,
)
from basketry.sources.tables import save_table, scratch_root
from tests.conftest import rows


@pytest.fixture(scope="module")
def tables(spark):
    root = scratch_root(spark)
    data = [(p, n, f"t{(p * n) % 50}", None, None, 1) for p in range(50) for n in range(20)]
    schema = "pid long, pos int, track_id string, artist_id string, album_id string, duration_ms long"
    items = save_table(spark.createDataFrame(data, schema), root, "items")
    popularity = save_table(item_popularity(items), root, "popularity")
    pairs = save_table(cooccurrence_pairs(items, popularity), root, "pairs")
    recommendations = save_table(recommend_popular(items, popularity, 5), root, "recommendations")
    splits = items.select("pid", F.lit("test").alias("split"), F.lit(20).alias("playlist_length")).distinct()
    return {
        "items": items, "popularity": popularity, "pairs": pairs, "recommendations": recommendations, "splits": splits
    }


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def test_no_operator_pairs_tables_without_a_key(tables):
    frames = (
        item_popularity(tables["items"]),
        recommend_popular(tables["items"], tables["popularity"], 10),
        cooccurrence_pairs(tables["items"], tables["popularity"]),
        recommend_cooccurrence(tables["items"], tables["pairs"], 10),
        ranking_metrics(tables["recommendations"], tables["items"], [5]),
    )
    for frame in frames:
        assert "CartesianProduct" not in plan(frame) and "NestedLoop" not in plan(frame)


def test_top_k_is_cut_before_the_shuffle(tables):
    spec = SplitSpec(min_length=1)
    for frame in (
        recommend_cooccurrence(tables["items"], tables["pairs"], 10),
        holdout_targets(tables["items"], tables["splits"], spec, "test"),
    ):
        assert "WindowGroupLimit" in plan(frame) and "Partial" in plan(frame)


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for name in ("autoBroadcastJoinThreshold", "adaptive.coalescePartitions.enabled"):
        spark.conf.unset(f"spark.sql.{name}")


@pytest.fixture
def giant(spark):
    """One collection with 40,000 rows, its splits, in files of their own."""
    data = spark.range(0, 40_000, 1, 8).select(
        F.lit(7).cast("bigint").alias("pid"), F.col("id").alias("pos"), *[F.lit("t").alias(c) for c in ("track_id", "artist_id", "album_id")],
        F.lit(1).cast("bigint").alias("duration_ms"),
    )
    splits = spark.createDataFrame([(7, "test", 40_000), (8, "test", 9)], "pid long, split string, playlist_length long")
    root = scratch_root(spark)
    return save_table(data, root, "giant"), save_table(splits, root, "splits")


def tasks_of(frame):
    return [r["count"] for r in frame.groupBy(F.spark_partition_id()).count().collect()]


def test_a_giant_is_ranked_in_many_tasks(spark, no_broadcast, giant):
    data, splits = giant
    ranked = holdout_rank(data, splits, SplitSpec(min_length=1), giant_rows=1000)
    assert rows(ranked, "mask_rank") == [(n,) for n in range(1, 40_001)]
    sizes = tasks_of(ranked.select("mask_rank", "pos"))
    assert len(sizes) > 4 and max(sizes) < 20_000
    targets = holdout_targets(data, splits, SplitSpec(min_length=1), "test")
    # Printed from the result down: the final cut, the shuffle, the partial cut.
    below = plan(targets).split("WindowGroupLimit", 1)[1]
    assert "Final" in below.split("\n")[0] and "Exchange" in below.split("Partial")[0] and "Partial" in below
    assert rows(targets, "pos") == rows(ranked.where("mask_rank <= hidden_count"), "pos")


def test_the_visible_part_of_a_giant_is_cut_in_many_tasks(spark, no_broadcast, giant):
    """No window, no pieces, no broadcast: the join with the cut-off may be divided."""
    data, splits = giant
    spec = SplitSpec(min_length=1)
    hidden = save_table(hidden_rows(data, splits, spec), scratch_root(spark), "hidden")
    small = {"skewJoin.skewedPartitionThresholdInBytes": "10k", "skewJoin.skewedPartitionFactor": "1.1", "advisoryPartitionSizeInBytes": "20k"}
    for name, value in small.items():
        spark.conf.set(f"spark.sql.adaptive.{name}", value)
    try:
        visible = visible_part(visible_rows(data, hidden, spec), "test")
        assert "Window" not in plan(visible) and "BroadcastExchange" not in plan(visible)
        path = f"{scratch_root(spark)}/visible"
        visible.withColumn("task", F.spark_partition_id()).write.parquet(path)
        written = spark.read.parquet(path)
        sizes = [r["count"] for r in written.groupBy("task").count().collect()]
        assert sum(sizes) == 40_000 - 10 and len(sizes) > 4 and max(sizes) < 20_000
        assert written.join(hidden, "pos").isEmpty()
    finally:
        for name in small:
            spark.conf.unset(f"spark.sql.adaptive.{name}")


def test_hot_ranks_are_looked_up_by_broadcast(tables, no_broadcast):
    for head_items in (50_000, 10):
        text = plan(cooccurrence_pairs(tables["items"], tables["popularity"], head_items=head_items))
        assert text.count("BroadcastHashJoin") >= 4


def test_an_item_without_a_rank_is_an_error(tables):
    partial = tables["popularity"].where("track_id <> 't7'")
    with pytest.raises(Exception, match="no row for the item t7"):
        cooccurrence_pairs(tables["items"], partial).collect()


def test_pairs_travel_as_two_numbers(tables):
    text = plan(cooccurrence_pairs(tables["items"], tables["popularity"]))
    assert "partial_sum" in text
    # Printed from the result down: the pairs are grouped, and shuffled, by two ranks.
    grouped = text.split("partial_sum", 1)[1].split("Exchange", 1)[0]
    assert "keys=[a#" in text and "track_id" not in text.split("partial_sum", 1)[0].rsplit("keys=[a#", 1)[1].split("]")[0] and grouped


def test_filters_reach_the_scan(tables):
    text = plan(cooccurrence_pairs(tables["items"], tables["popularity"]))
    assert "PushedFilters: [IsNotNull(train_frequency)" in text and "GreaterThanOrEqual(train_frequency,5)" in text
