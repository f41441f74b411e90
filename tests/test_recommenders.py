"""Popularity and co-occurrence against brute force, with blocks and heads small enough to be crossed."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from basketry.operators import (
    cooccurrence_pairs, item_popularity, popularity_candidates, recommend_cooccurrence, recommend_popular,
    recommendations_union,
)
from basketry.operators.cooccurrence import sized_items, support_bounds, vote_steps
from basketry.plans import standin
from basketry.sources.tables import scratch_root
from tests.conftest import rows


def baskets(seed, collections=40, items=60, hot=True):
    rng = random.Random(seed)
    data = [(pid, f"i{int(items * rng.random() ** 2):03d}") for pid in range(collections) for _ in range(rng.randint(1, 15))]
    if hot:
        data += [(1000, f"i{n % items:03d}") for n in range(len(data) // 2)]  # one collection with a third of all rows
    return data


def frame(spark, data):
    return spark.createDataFrame(data, "pid long, track_id string")


def popularity_of(data):
    ranked = sorted(Counter(i for _, i in data).items(), key=lambda x: (-x[1], x[0]))
    return [(i, n, r) for r, (i, n) in enumerate(ranked, 1)]


@pytest.mark.parametrize("tasks", ["1", "8", "64"])
def test_popularity(spark, tasks):
    data = baskets(1)
    spark.conf.set("spark.sql.shuffle.partitions", tasks)
    try:
        assert rows(item_popularity(frame(spark, data))) == sorted(popularity_of(data))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_a_million_items_of_one_frequency_are_ranked_in_many_tasks(spark):
    """No list of cuts is gathered, and no task ranks them all."""
    train = spark.range(1_000_000).select(F.lit(1).alias("pid"), (F.col("id") * 7919 % 1_000_000).alias("track_id"))
    ranked = item_popularity(train)
    assert ranked.where(F.col("popularity_rank") != F.col("track_id") + 1).isEmpty()
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert "collect_set" not in plan and "Window" not in plan.split("BroadcastExchange")[0]
    sizes = [r["count"] for r in ranked.groupBy(F.spark_partition_id()).count().collect()]
    files = [r["count"] for r in ranked.groupBy(F.col("_metadata.file_name")).count().collect()] if "_metadata" in ranked.columns else sizes
    assert sum(sizes) == 1_000_000 and len(files) > 4 and max(files) < 400_000


def test_popularity_of_nothing(spark):
    assert item_popularity(frame(spark, [])).count() == 0


def popular_lists(context, train, k):
    seen = {}
    for pid, item in context:
        seen.setdefault(pid, set()).add(item)
    for pid, items in seen.items():
        unseen = [(i, n) for i, n, _ in popularity_of(train) if i not in items][:k]
        for rank, (i, n) in enumerate(unseen, 1):
            yield ("popularity", pid, rank, i, float(n))


@pytest.mark.parametrize("block_ranks, head_items", [(1024, 50_000), (1, 3), (2, 10), (7, 1)])
@pytest.mark.parametrize("k", [1, 4, 100])
def test_popular_items_fill_the_gaps(spark, block_ranks, head_items, k):
    train, context = baskets(2), baskets(3, collections=25, items=80)
    context += [(2000, "unheard-of"), (2001, "i000")]
    popularity = item_popularity(frame(spark, train)).cache()
    got = recommend_popular(frame(spark, context), popularity, k, block_ranks, head_items)
    assert rows(got) == sorted(popular_lists(context, train, k))


def test_candidate_pool_is_as_large_as_the_largest_context_demands(spark):
    train, context = baskets(2, items=300, collections=200), baskets(3, items=30)
    largest = max(Counter(pid for pid, _ in set(context)).values())
    pool = popularity_candidates(frame(spark, context), item_popularity(frame(spark, train)), 3)
    ranked = popularity_of(train)
    assert rows(pool) == sorted(ranked[: 3 + largest + 50]) and len(ranked) > 3 + largest + 50


def pairs_of(data, support, floor):
    frequency, counts = Counter(i for _, i in data), Counter()
    by_pid = {}
    for pid, item in data:
        by_pid.setdefault(pid, []).append(item)
    for items in by_pid.values():
        counts.update((a, b) for a in items for b in items if a != b)
    return {
        (a, b): (n, frequency[b]) for (a, b), n in counts.items() if n >= support and frequency[b] >= floor
    }


@pytest.mark.parametrize("block_items, head_items", [(1024, 50_000), (4, 5), (1, 1)])
@pytest.mark.parametrize("support, floor", [(1, 1), (3, 5), (8, 12)])
def test_pairs(spark, block_items, head_items, support, floor):
    data = baskets(4)
    popularity = item_popularity(frame(spark, data)).cache()
    got = cooccurrence_pairs(frame(spark, data), popularity, support, floor, block_items, head_items)
    assert rows(got) == sorted((a, b, n, p) for (a, b), (n, p) in pairs_of(data, support, floor).items())


def test_pairs_do_not_depend_on_partitions(spark):
    train = frame(spark, baskets(5))
    popularity = item_popularity(train).cache()
    expected = rows(cooccurrence_pairs(train, popularity, block_items=6))
    for n in (1, 7, 64):
        assert rows(cooccurrence_pairs(train.repartition(n), popularity, block_items=6)) == expected


def test_pairs_without_enough_support_are_never_made(spark):
    """The bound of an item holds for every pair of it, and items below the support are gone before the join."""
    data = baskets(8, collections=60, items=200, hot=False) + [(p, "i000") for p in range(60) for _ in range(p % 3)]
    train = frame(spark, data)
    bounds = {r.track_id: int(r.bound) for r in support_bounds(sized_items(train)).collect()}
    for (a, b), (support, _) in pairs_of(data, 1, 1).items():
        assert support <= min(bounds[a], bounds[b])
    able = {item for item, bound in bounds.items() if bound >= 12}
    assert 0 < len(able) < len(bounds) / 2
    popularity = item_popularity(train).cache()
    got = cooccurrence_pairs(train, popularity, 12, 1)
    assert rows(got) == sorted((a, b, n, p) for (a, b), (n, p) in pairs_of(data, 12, 1).items())
    # An item that is left out needs no rank; one that is not does.
    rare = min(bounds, key=bounds.get)
    assert rows(cooccurrence_pairs(train, popularity.where(F.col("track_id") != rare), 12, 1)) == rows(got)


def test_lone_items_and_products_beyond_64_bits(spark):
    train = frame(spark, [(1, "a")] * 5 + [(2, "b"), (2, "c")] + [(None, "b"), (3, None)])
    assert {r.pid for r in sized_items(train).collect()} == {2}
    many = spark.createDataFrame([("a", 2**40, 2**40)] * 3, "track_id string, occurrences long, most long")
    assert [int(r.bound) for r in support_bounds(many).collect()] == [3 * 2**80]


def test_early_end_saves_votes(spark):
    """Many weak partners: few collections need them, and only for candidates that may still win."""
    rng = random.Random(11)
    items = [f"i{n:03d}" for n in range(120)]
    pairs = [(a, b, 1000 + rng.randint(0, 50) if abs(n - m) < 4 else rng.randint(1, 3), 10) for n, a in enumerate(items) for m, b in enumerate(items) if a != b]
    context = [(p, rng.choice(items)) for p in range(80) for _ in range(4)] + [(900, items[0])]
    table = spark.createDataFrame(pairs, "context_track_id string, candidate_track_id string, pair_support long, candidate_popularity long").cache()
    known = frame(spark, context).cache()
    weights = known.groupBy("pid", "track_id").agg(F.count("*").alias("occurrences")).cache()
    partners = table.withColumnRenamed("context_track_id", "track_id")
    before = weights.join(partners, "track_id").count()
    steps = vote_steps(weights, known, partners, 3, 6, 1024, scratch_root(spark))
    after = steps.first.count() + steps.looked_up.count() + steps.rest.count()
    assert steps.settled.count() > 60 and after < before / 3
    whole = recommend_cooccurrence(known, table, 3)
    for depth in (1, 6, 40):
        assert rows(recommend_cooccurrence(known, table, 3, depth=depth)) == rows(whole)


@pytest.mark.parametrize("k, block_rows, depth", [(1, 1024, 1000), (5, 3, 2), (100, 1, 1), (3, 1024, 1), (1, 1024, 1), (2, 2, 5)])
def test_cooccurring_items(spark, k, block_rows, depth):
    train, context = baskets(6), baskets(7, collections=20, hot=False) + [(3000, "unheard-of")]
    pairs = pairs_of(train, 2, 3)
    scores, seen = {}, set(context)
    for pid, item in context:
        for (a, b), (n, p) in pairs.items():
            if a == item and (pid, b) not in seen:
                scores.setdefault(pid, Counter())[(b, p)] += n
    expected = []
    for pid, votes in scores.items():
        best = sorted(votes.items(), key=lambda v: (-v[1], -v[0][1], v[0][0]))[:k]
        expected += [("cooccurrence", pid, rank, b, float(n)) for rank, ((b, _), n) in enumerate(best, 1)]
    table = spark.createDataFrame(
        [(a, b, n, p) for (a, b), (n, p) in pairs.items()],
        "context_track_id string, candidate_track_id string, pair_support long, candidate_popularity long",
    )
    got = recommend_cooccurrence(frame(spark, context), table, k, block_rows, depth)
    assert rows(got) == sorted(expected)
    union = recommendations_union(got, got.withColumn("baseline_name", F.lit("again")))
    assert union.count() == 2 * len(expected)


@pytest.mark.parametrize("giant_rows", [1, 40])
def test_positions_of_giant_customers(spark, giant_rows):
    small = "/root/testdata/sf0.001"
    assert rows(standin.baskets(spark, small, giant_rows)) == rows(standin.baskets(spark, small))
