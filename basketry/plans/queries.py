"""Every operator as a query over the test tables. ``oracle.py`` states the same results in SQL.

Hashes run in md5 mode here, which the oracle's SQL dialect can reproduce. Queries with several steps write the
tables between the steps to a scratch folder, as the jobs do.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from basketry.functions.text import SLICE_NAME, clean_text, last_segment_id, source_slice_range
from basketry.operators.cooccurrence import cooccurrence_pairs, recommend_cooccurrence, recommendations_union
from basketry.operators.flatten import flatten_collections, flatten_interactions, item_dimension
from basketry.operators.metrics import hits_and_dcg, ideal_dcg, metrics_report, ranking_metrics, target_counts
from basketry.operators.popularity import item_popularity, popularity_candidates, recommend_popular
from basketry.operators.sampling import restrict_run_tables, sample_collections
from basketry.operators.splits import (
    EVALUATION,
    SplitSpec,
    collection_lengths,
    hash_split,
    hidden_part,
    hidden_rows,
    holdout_budget,
    holdout_rank,
    holdout_targets,
    split_counts,
    train_interactions,
    visible_part,
    visible_rows,
)
from basketry.operators.summaries import ingest_summary, run_summary, split_summary
from basketry.plans import standin
from basketry.plans.jobs import build_splits, ingest, run_baselines
from basketry.sources.documents import collections_of, parse_documents, scan_nested_json
from basketry.sources.tables import load_layer, save_table, scratch_root, write_tables

Query = Callable[[SparkSession, str], DataFrame]

SPEC = SplitSpec(hash_fn="md5")
KS = (10, 50, 100)
MAX_K = max(KS)
TRAIN_SAMPLE, VALIDATION_SAMPLE = 500, 25


def _collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collections_of(parse_documents(standin.documents(spark, sf_dir)))


def _splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = standin.customer_items(spark, sf_dir)
    return hash_split(collection_lengths(standin.headers(spark, sf_dir), items), SPEC)


def _evaluated(spark: SparkSession, sf_dir: str, root: str, names: Sequence[str] = ("validation",)) -> DataFrame:
    """Baskets that the hash may put into the splits ``names``, written once: all that a hold-out of them can need."""
    return save_table(standin.baskets(spark, sf_dir, of=SPEC.hash_label().isin(*names)), root, "evaluated")


def _holdout(baskets: DataFrame, splits: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """Visible and hidden rows of the validation split, each written once. ``baskets`` and ``splits``: written tables."""
    hidden = save_table(hidden_rows(baskets, splits, SPEC, ["validation"], splits_from_spec=True), root, "hidden")
    visible = visible_rows(baskets, hidden, SPEC, ["validation"], splits_from_spec=True)
    return visible_part(save_table(visible, root, "visible"), "validation"), hidden_part(hidden, "validation")


class _Run:
    """Train, context and targets of the validation split, and what is built on them, each written once."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self._root = scratch_root(spark)
        splits = save_table(_splits(spark, sf_dir), self._root, "splits")
        items = standin.customer_items(spark, sf_dir)
        members = splits.where(F.col("split") == "train").select("pid")
        self.train = items.join(members, "pid", "left_semi")
        self.context, self.targets = _holdout(_evaluated(spark, sf_dir, self._root), splits, self._root)
        self._popularity: DataFrame | None = None

    @property
    def popularity(self) -> DataFrame:
        if self._popularity is None:
            self.train = save_table(self.train, self._root, "train")
            self._popularity = save_table(item_popularity(self.train, self._root), self._root, "popularity")
        return self._popularity

    def pairs(self) -> DataFrame:
        popularity = self.popularity
        return save_table(cooccurrence_pairs(self.train, popularity, root=self._root), self._root, "pairs")

    def recommend(self) -> DataFrame:
        union = recommendations_union(
            recommend_popular(self.context, self.popularity, MAX_K),
            recommend_cooccurrence(self.context, self.pairs(), MAX_K, root=self._root),
        )
        return save_table(union, self._root, "recommendations")


def q_scan_nested_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default file names, found inside the name; a file of another name is not read."""
    folder = f"{scratch_root(spark)}/documents"
    standin.write_documents(spark, sf_dir, f"{folder}/deeper", "full_mpd.slice.7-1006")
    spark.range(1).select(F.lit(1).alias("playlists")).write.option("mapreduce.output.basename", "mpd.slice.x-y").json(f"{folder}/others")
    playlist = F.col("playlist")
    start, end = source_slice_range("source_file")
    return scan_nested_json(spark, folder).select(
        start.alias("slice_start"),
        end.alias("slice_end"),
        playlist["pid"].alias("pid"),
        playlist["name"].alias("name"),
        playlist["num_tracks"].alias("num_tracks"),
        F.size(playlist["tracks"]).alias("items"),
        F.aggregate(playlist["tracks"], F.lit(0).cast("bigint"), lambda t, x: t + x["duration_ms"]).alias("duration"),
    )


def q_clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    def cleaned(name: str, key: str, text) -> DataFrame:
        rows = standin.table(spark, sf_dir, name)
        return rows.select(F.lit(name).alias("source"), F.col(key).alias("id"), clean_text(text).alias("cleaned"))

    padded = F.concat(F.lit("  "), F.col("c_name"), F.lit("\t "))
    blank = F.when(F.col("p_size") > 25, F.lit("   ")).otherwise(F.concat(F.lit(" "), F.col("p_name")))
    return (
        cleaned("customer", "c_custkey", padded)
        .unionByName(cleaned("part", "p_partkey", blank))
        .unionByName(cleaned("documents", "doc_id", F.col("text")))
    )


def q_last_segment_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, parts = (standin.table(spark, sf_dir, t) for t in ("pages", "part"))
    uri = F.concat(F.lit(" x:part:"), F.when(F.col("p_size") > 5, F.col("p_name")).otherwise(""))
    return pages.select(F.col("page_id").alias("id"), "url", last_segment_id("url", "/").alias("segment")).unionByName(
        parts.select(F.col("p_partkey").alias("id"), uri.alias("url"), last_segment_id(uri).alias("segment"))
    )


def q_source_slice_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    path = F.when(key % 7 == 0, F.concat(F.lit("in/mpd.slice.1-2/other."), key.cast("string"), F.lit(".json"))).otherwise(
        F.format_string("in/mpd.slice.7-8/mpd.slice.%d-%d.json", key, key + 999)
    )
    start, end = source_slice_range(path)
    return standin.table(spark, sf_dir, "orders").select(
        "o_orderkey", start.alias("slice_start"), end.alias("slice_end")
    )


def q_write_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables committed together; the first is read back with all its columns, the second counted."""
    items = standin.order_items(spark, sf_dir)
    paths = write_tables({"playlists": standin.headers(spark, sf_dir), "items": items}, scratch_root(spark))
    held = spark.read.parquet(paths["items"]).agg(F.count(F.lit(1)).alias("items"))
    return spark.read.parquet(paths["playlists"]).select("pid", "name", "num_tracks").crossJoin(F.broadcast(held))


def q_load_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    layer = load_layer(spark, sf_dir, ("customer", "orders", "lineitem"))
    counts = [rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table"), "n") for name, rows in layer.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


def q_collection_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collection_lengths(standin.headers(spark, sf_dir), standin.customer_items(spark, sf_dir))


def q_hash_split_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as collections: many are shorter than the minimum length."""
    orders = standin.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("pid"), F.lit(12).cast("bigint").alias("num_tracks")
    )
    return hash_split(collection_lengths(orders, standin.order_items(spark, sf_dir)), SPEC)


def q_holdout_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = standin.conversation_turns(spark, sf_dir).select(
        "pid", "pos", "track_id", *[F.lit(None).cast("string").alias(c) for c in ("artist_id", "album_id")],
        F.lit(None).cast("bigint").alias("duration_ms"),
    )
    pids = turns.select("pid", F.lit(None).cast("bigint").alias("num_tracks")).distinct()
    spec = SplitSpec(0.5, 0.3, 0.2, min_length=3, mask_fraction=0.3, max_hidden=2, hash_fn="md5")
    splits = hash_split(collection_lengths(pids, turns), spec)
    return holdout_rank(turns, splits, spec, splits_from_spec=True).select(
        "pid", "pos", "track_id", "split", "hidden_count", "mask_rank"
    )


def q_train_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return train_interactions(standin.baskets(spark, sf_dir), _splits(spark, sf_dir), SPEC)


def q_holdout_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_root(spark)
    splits = save_table(_splits(spark, sf_dir), root, "splits")
    baskets = standin.baskets(spark, sf_dir, of=SPEC.hash_label().isin(*EVALUATION))
    ranked = holdout_rank(baskets, splits, SPEC, splits_from_spec=True, root=root)
    return ranked.withColumn("mask_score", F.col("mask_score").cast("bigint"))


def q_holdout_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_root(spark)
    baskets = _evaluated(spark, sf_dir, root)
    hidden = hidden_rows(baskets, _splits(spark, sf_dir), SPEC, ["validation"], True)
    hidden = save_table(hidden, root, "hidden")
    return visible_part(visible_rows(baskets, hidden, SPEC, ["validation"], True), "validation")


def q_holdout_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    baskets = standin.baskets(spark, sf_dir, of=SPEC.hash_label() == "validation")
    return holdout_targets(baskets, _splits(spark, sf_dir), SPEC, "validation", True)


def q_sample_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_collections(standin.customer_items(spark, sf_dir), "train", TRAIN_SAMPLE, hash_fn="md5")


def q_sample_collections_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = standin.order_items(spark, sf_dir)
    return sample_collections(rows, "train", 10_000, hash_fn="md5", sorted_sample=0)


def q_restrict_run_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_root(spark)
    baskets, splits = save_table(standin.baskets(spark, sf_dir), root, "baskets"), save_table(_splits(spark, sf_dir), root, "splits")
    train = train_interactions(baskets, splits, SPEC)
    context, targets = _holdout(baskets, splits, root)
    tables = restrict_run_tables(train, context, targets, TRAIN_SAMPLE, VALIDATION_SAMPLE, hash_fn="md5")
    labelled = [rows.withColumn("run_table", F.lit(name)) for name, rows in zip(("train", "context", "targets"), tables)]
    return labelled[0].unionByName(labelled[1]).unionByName(labelled[2])


def _pairs(rows: DataFrame) -> DataFrame:
    root = scratch_root(rows.sparkSession)
    rows = save_table(rows, root, "rows")
    popularity = save_table(item_popularity(rows, root), root, "popularity")
    return cooccurrence_pairs(rows, popularity, root=root)


def q_item_popularity_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return item_popularity(standin.event_items(spark, sf_dir))


def q_popularity_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = _Run(spark, sf_dir)
    return popularity_candidates(run.context, run.popularity, MAX_K)


def q_recommend_popular(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = _Run(spark, sf_dir)
    return recommend_popular(run.context, run.popularity, MAX_K)


def q_recommend_popular_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users who have seen most of a small catalogue: the lists run out of items."""
    events = standin.event_items(spark, sf_dir)
    popularity = save_table(item_popularity(events), scratch_root(spark), "popularity")
    return recommend_popular(events, popularity, MAX_K)


def q_recommend_cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = _Run(spark, sf_dir)
    return recommend_cooccurrence(run.context, run.pairs(), MAX_K)


def q_recommendations_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _Run(spark, sf_dir).recommend()


def q_ideal_dcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct part counts per order as target counts."""
    counts = target_counts(standin.order_items(spark, sf_dir)).select("target_count").distinct()
    asked = counts.select("target_count", F.explode(F.array(*[F.lit(k) for k in (1, 3, *KS)])).alias("k"))
    return asked.withColumn("idcg", ideal_dcg("target_count", "k"))


def q_hits_and_dcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = _Run(spark, sf_dir)
    return hits_and_dcg(run.recommend(), run.targets, KS)


def q_ranking_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = _Run(spark, sf_dir)
    return ranking_metrics(run.recommend(), run.targets, KS)


def q_metrics_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = _Run(spark, sf_dir)
    report = metrics_report(ranking_metrics(run.recommend(), run.targets, KS))
    entries = report.select(F.explode("baselines").alias("baseline_name", "values"))
    return entries.select("baseline_name", F.explode("values").alias("metric", "value"))


def q_run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = _Run(spark, sf_dir)
    return run_summary(run.train, run.context, full_data=True)


def q_end_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases -> splits -> popularity and pairs -> recommendations -> metrics, through the written layers."""
    root = scratch_root(spark)
    silver, gold, artifacts = (f"{root}/{layer}" for layer in ("silver", "gold", "artifacts"))
    write_tables(
        {"playlists": standin.headers(spark, sf_dir), "playlist_tracks": standin.baskets(spark, sf_dir)}, silver
    )
    build_splits(spark, silver, gold, SPEC, complete_headers=True)
    metrics, _ = run_baselines(spark, gold, artifacts, KS, full_data=True, hash_fn="md5")
    return metrics


def q_end_to_end_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same flow in its default mode, on a sample of the collections."""
    root = scratch_root(spark)
    silver, gold, artifacts = (f"{root}/{layer}" for layer in ("silver", "gold", "artifacts"))
    write_tables(
        {"playlists": standin.headers(spark, sf_dir), "playlist_tracks": standin.baskets(spark, sf_dir)}, silver
    )
    build_splits(spark, silver, gold, SPEC, complete_headers=True)
    metrics, _ = run_baselines(
        spark, gold, artifacts, KS, train_sample_size=TRAIN_SAMPLE, validation_sample_size=VALIDATION_SAMPLE, hash_fn="md5"
    )
    return metrics


def q_end_to_end_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All three jobs, from nested documents on, which are compressed files here."""
    root = scratch_root(spark)
    bronze, silver, gold, artifacts = (f"{root}/{layer}" for layer in ("bronze", "silver", "gold", "artifacts"))
    standin.write_documents(spark, sf_dir, bronze, "mpd.slice.0-999", compression="gzip")
    ingest(spark, bronze, silver, name_glob="*mpd.slice.*-*.json.gz", name_pattern=SLICE_NAME + r".*\.json\.gz$")
    build_splits(spark, silver, gold, SPEC, complete_headers=True)
    metrics, _ = run_baselines(spark, gold, artifacts, KS, full_data=True, hash_fn="md5")
    return metrics


def queries() -> dict[str, Query]:
    return {
        "scan_nested_json": q_scan_nested_json,
        "flatten_collections": lambda s, d: flatten_collections(_collections(s, d)),
        "item_dimension": lambda s, d: item_dimension(_collections(s, d)),
        "flatten_interactions": lambda s, d: flatten_interactions(_collections(s, d)),
        "clean_text": q_clean_text,
        "last_segment_id": q_last_segment_id,
        "source_slice_range": q_source_slice_range,
        "write_tables": q_write_tables,
        "load_layer": q_load_layer,
        "collection_lengths": q_collection_lengths,
        "hash_split": _splits,
        "hash_split_orders": q_hash_split_orders,
        "train_interactions": q_train_interactions,
        "holdout_budget": lambda s, d: holdout_budget(_splits(s, d), SPEC),
        "holdout_rank": q_holdout_rank,
        "holdout_conversations": q_holdout_conversations,
        "holdout_context": q_holdout_context,
        "holdout_targets": q_holdout_targets,
        "split_counts": lambda s, d: split_counts(_splits(s, d)),
        "split_summary": lambda s, d: split_summary(_splits(s, d)),
        "sample_collections": q_sample_collections,
        "sample_collections_histogram": q_sample_collections_histogram,
        "restrict_run_tables": q_restrict_run_tables,
        "item_popularity": lambda s, d: item_popularity(standin.customer_items(s, d)),
        "item_popularity_events": q_item_popularity_events,
        "popularity_candidates": q_popularity_candidates,
        "recommend_popular": q_recommend_popular,
        "recommend_popular_events": q_recommend_popular_events,
        "cooccurrence_pairs": lambda s, d: _pairs(standin.customer_items(s, d)),
        "cooccurrence_pairs_orders": lambda s, d: _pairs(standin.order_items(s, d)),
        "cooccurrence_pairs_events": lambda s, d: _pairs(standin.event_items(s, d)),
        "recommend_cooccurrence": q_recommend_cooccurrence,
        "recommendations_union": q_recommendations_union,
        "ideal_dcg": q_ideal_dcg,
        "hits_and_dcg": q_hits_and_dcg,
        "ranking_metrics": q_ranking_metrics,
        "metrics_report": q_metrics_report,
        "ingest_summary": lambda s, d: ingest_summary(parse_documents(standin.documents(s, d))),
        "run_summary": q_run_summary,
        "end_to_end": q_end_to_end,
        "end_to_end_sampled": q_end_to_end_sampled,
        "end_to_end_documents": q_end_to_end_documents,
    }
