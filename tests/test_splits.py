from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from basketry.operators import (
    SplitSpec, collection_lengths, hash_split, holdout_budget, holdout_context, holdout_rank, holdout_targets,
    restrict_run_tables, sample_collections, split_counts, split_summary, train_interactions,
)
from basketry.operators.splits import INTERACTION, hidden_part, hidden_rows, visible_part, visible_rows
from tests.conftest import rows

SCHEMA = "pid long, pos int, track_id string, artist_id string, album_id string, duration_ms long"
SPEC = SplitSpec(0.4, 0.3, 0.3, hash_fn="md5")


def collection(pid, length):
    return [(pid, pos, f"t{pos % 17}", None, None, pos) for pos in range(length)]


@pytest.fixture(scope="module")
def interactions(spark):
    data = [row for pid in range(60) for row in collection(pid, (pid * 7) % 53)]
    return spark.createDataFrame(data, SCHEMA).cache()


@pytest.fixture(scope="module")
def splits(spark, interactions):
    headers = spark.range(60).select(F.col("id").alias("pid"), F.lit(12).cast("long").alias("num_tracks"))
    return hash_split(collection_lengths(headers, interactions), SPEC).cache()


def test_length_falls_back_to_the_declared_one(spark):
    headers = spark.createDataFrame([(1, 3), (2, 12), (3, None)], "pid long, num_tracks long")
    items = spark.createDataFrame(collection(1, 5), SCHEMA)
    assert rows(collection_lengths(headers, items)) == [(1, 5), (2, 12), (3, 0)]


@pytest.mark.parametrize("length, hidden", [(1, 1), (4, 1), (5, 1), (6, 2), (49, 10), (50, 10), (51, 10)])
def test_budget(spark, length, hidden):
    frame = spark.createDataFrame([(1, "test", length)], "pid long, split string, playlist_length long")
    assert holdout_budget(frame, SplitSpec()).first().hidden_count == hidden


def test_labels(spark, splits):
    for r in splits.collect():
        assert r.eligible_for_eval == (r.split != "train")
        assert r.playlist_length >= SPEC.min_length or r.split == "train"
    counts = {r.split: r.playlists for r in split_counts(splits).collect()}
    assert sum(counts.values()) == 60 and len(counts) == 3
    summary = split_summary(splits).first()
    assert summary.eligible_eval_playlists == counts["validation"] + counts["test"]
    assert summary.train_playlists == counts["train"]


def test_label_follows_the_default_hash(spark):
    lengths = spark.range(500).select(F.col("id").alias("pid"), F.lit(9).alias("playlist_length"))
    score = F.pmod(F.xxhash64(F.lit("42"), F.col("pid").cast("string")), F.lit(1000000)) / 1e6
    labelled = hash_split(lengths, SplitSpec()).withColumn("score", score).collect()
    for r in labelled:
        assert r.split == ("train" if r.score < 0.9 else "validation" if r.score < 0.9 + 0.05 else "test")


def test_the_score_at_the_upper_cut_is_validation():
    assert 0.95 < 0.9 + 0.05


def test_split_parts_add_up(spark, interactions, splits):
    train = train_interactions(interactions, splits)
    ranked = holdout_rank(interactions, splits, SPEC)
    parts = train
    for name in ("validation", "test"):
        context, targets = holdout_context(ranked, name), holdout_targets(interactions, splits, SPEC, name)
        assert rows(targets) == rows(hidden_part(ranked, name))
        assert context.join(targets, ["pid", "pos"]).count() == 0
        parts = parts.unionByName(context).unionByName(targets)
    assert rows(parts) == rows(interactions)
    budgets = {r.pid: r.hidden_count for r in holdout_budget(splits, SPEC).collect()}
    for r in ranked.groupBy("pid").agg(F.count_if(F.col("mask_rank") <= F.col("hidden_count")).alias("n"), F.count("*").alias("all")).collect():
        assert r.n == min(budgets[r.pid], r["all"])


def test_shortcuts_give_the_same_rows(spark, interactions, splits):
    assert rows(train_interactions(interactions, splits, SPEC)) == rows(train_interactions(interactions, splits))
    slow = holdout_rank(interactions, splits, SPEC)
    assert rows(holdout_rank(interactions, splits, SPEC, splits_from_spec=True)) == rows(slow)
    assert rows(holdout_targets(interactions, splits, SPEC, "test", True)) == rows(
        holdout_targets(interactions, splits, SPEC, "test")
    )


@pytest.mark.parametrize("hash_fn, exact", [("md5", False), ("xxhash64", True)])
def test_the_cut_off_parts_what_the_ranks_part(spark, interactions, splits, hash_fn, exact):
    spec = replace(SPEC, hash_fn=hash_fn, exact_mask_scores=exact)
    # Every third collection has each row twice, or four times: the cut may part equal rows.
    copies = interactions.where("pid % 3 = 0")
    several = interactions.unionByName(copies).unionByName(copies.where("pid % 2 = 0")).unionByName(copies.where("pid % 2 = 0"))
    made = hash_split(splits.select("pid", "playlist_length"), spec).cache()
    for rows_of in (interactions, several):
        ranked = holdout_rank(rows_of, made, spec).cache()
        for from_spec in (False, True):
            hidden = hidden_rows(rows_of, made, spec, splits_from_spec=from_spec).cache()
            assert rows(hidden) == rows(ranked.where("mask_rank <= hidden_count"))
            visible = visible_rows(rows_of, hidden, spec, splits_from_spec=from_spec)
            expected = ranked.where("mask_rank > hidden_count").select("split", *INTERACTION)
            assert rows(visible) == rows(expected)
    assert rows(visible_part(visible, "test")) == rows(holdout_context(ranked, "test"))
    assert rows(hidden_part(hidden, "test")) == rows(hidden_part(ranked, "test"))


@pytest.mark.parametrize("exact", [False, True])
@pytest.mark.parametrize("hash_fn", ["md5", "xxhash64"])
def test_ranking_by_ranges_equals_ranking_whole(spark, interactions, splits, hash_fn, exact):
    spec = replace(SPEC, hash_fn=hash_fn, exact_mask_scores=exact)
    whole = rows(holdout_rank(interactions, splits, spec))
    for giant_rows in (1, 6, 20):
        assert rows(holdout_rank(interactions, splits, spec, giant_rows=giant_rows)) == whole


def test_ranks_do_not_depend_on_partitions_or_row_order(spark, interactions, splits):
    twice = interactions.unionByName(interactions.where("pid % 3 = 0"))
    expected = rows(holdout_rank(twice, splits, SPEC))
    for n in (1, 7, 64):
        assert rows(holdout_rank(twice.repartition(n), splits, SPEC)) == expected
    ranks = {}
    for r in expected:
        ranks.setdefault(r[0], []).append(r[-1])
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in ranks.values())


def test_repeated_headers_do_not_repeat_interactions(spark, interactions, splits):
    doubled = splits.unionByName(splits)
    assert rows(train_interactions(interactions, doubled)) == rows(train_interactions(interactions, splits))
    assert rows(holdout_rank(interactions, doubled, SPEC)) == rows(holdout_rank(interactions, splits, SPEC))


def test_everything_hidden_leaves_no_context(spark):
    items = spark.createDataFrame(collection(1, 1), SCHEMA)
    splits = spark.createDataFrame([(1, "test", 1)], "pid long, split string, playlist_length long")
    ranked = holdout_rank(items, splits, SplitSpec(min_length=1))
    assert holdout_context(ranked, "test").count() == 0
    assert hidden_part(ranked, "test").count() == 1


def test_both_ways_to_sample_agree(spark):
    pids = spark.range(5000).select((F.col("id") % 3000).alias("pid"))
    for size in (0, 1, 137, 2999, 3000, 4000):
        by_sort = rows(sample_collections(pids, "train", size))
        assert by_sort == rows(sample_collections(pids, "train", size, sorted_sample=-1))
        assert len(by_sort) == min(size, 3000)
    assert sample_collections(pids, "train", None).count() == 3000
    assert rows(sample_collections(pids, "train", 100)) != rows(sample_collections(pids, "validation", 100))


def test_ties_in_the_sample_go_to_lower_pids(spark):
    pids = spark.range(200_000).select(F.col("id").alias("pid"))
    expected = rows(sample_collections(pids, "train", 50_000, sorted_sample=10**6))
    assert rows(sample_collections(pids, "train", 50_000, sorted_sample=-1)) == expected


def test_run_tables(spark, interactions):
    holes = interactions.withColumn("track_id", F.when(F.col("pos") != 2, F.col("track_id")))
    context, targets = holes.where("pid < 30"), holes.where("pid > 10 AND pid < 40")
    train, ctx, tgt = restrict_run_tables(holes, context, targets, 5, 8)
    sampled = {r.pid for r in sample_collections(context, "validation", 8).collect()}
    assert train.select("pid").distinct().count() <= 5
    assert {r.pid for r in ctx.collect()} <= sampled and {r.pid for r in tgt.collect()} <= sampled
    assert ctx.columns == list(INTERACTION) and ctx.where("track_id IS NULL").count() == 0
    full = restrict_run_tables(holes, context, targets, None, None)
    assert full[0].count() == holes.where("track_id IS NOT NULL").count()
    assert full[2].where("pid >= 30").count() == 0
