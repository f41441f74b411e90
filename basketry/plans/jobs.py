"""The three batch jobs: documents -> tables, tables -> splits, splits -> recommendations and metrics.

Each job writes its tables and goes on from what it wrote: nothing is computed twice, no lineage grows from
job to job, and a lost executor costs no more than one table. A job's tables appear together when it has ended; a job
that fails leaves its output folder as it was.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F

from basketry.functions.checks import validate_ks
from basketry.operators.cooccurrence import cooccurrence_pairs, recommend_cooccurrence, recommendations_union
from basketry.operators.flatten import flatten_collections, flatten_interactions, item_dimension
from basketry.operators.metrics import metrics_report, ranking_metrics, report_json
from basketry.operators.popularity import item_popularity, recommend_popular
from basketry.operators.sampling import restrict_run_tables
from basketry.operators.splits import (
    EVALUATION,
    SplitSpec,
    collection_lengths,
    hash_split,
    hidden_part,
    hidden_rows,
    train_interactions,
    visible_part,
    visible_rows,
)
from basketry.operators.summaries import ingest_summary, run_summary, split_summary
from basketry.sources.documents import collections_of, read_documents
from basketry.sources.tables import exists, held, layer, load_layer, save_table, save_tables, scratch, table_path, write_text

SILVER = ("playlists", "tracks", "playlist_tracks")
GOLD = (
    "playlist_splits",
    "train_playlist_tracks",
    "validation_context",
    "validation_targets",
    "test_context",
    "test_targets",
)
ARTIFACTS = ("track_popularity", "cooccurrence_pairs", "validation_recommendations")
METRICS_FILE = "validation_metrics.json"


def ingest(
    spark: SparkSession,
    input_dir: str,
    output_dir: str,
    overwrite: bool = False,
    scratch_dir: str | None = None,
    **read_options: str,
) -> DataFrame:
    """Flatten all documents below ``input_dir`` into three tables; returns a one-row summary.

    The JSON text is parsed once. The tables are then cut from a columnar copy, each reading only the nested
    fields it needs. The copy lies in ``scratch_dir``, or below ``spark.checkpoint.dir``, and is removed at the end.
    """
    with layer(spark, output_dir, SILVER, overwrite) as staged, scratch(spark, scratch_dir) as root:
        documents = save_table(read_documents(spark, input_dir, **read_options), root, "documents")
        collections = collections_of(documents)
        tables = {
            "playlists": flatten_collections(collections),
            "tracks": item_dimension(collections),
            "playlist_tracks": flatten_interactions(collections),
        }
        save_tables(tables, staged)
        return held(_with_paths(ingest_summary(documents), input_dir, output_dir, SILVER))


def _with_paths(summary: DataFrame, input_dir: str, output_dir: str, names: Iterable[str]) -> DataFrame:
    """The summary with the folders of the job and the path of each table it wrote."""
    paths = {f"{name}_path": F.lit(table_path(output_dir, name)) for name in names}
    return summary.withColumns({"input_path": F.lit(input_dir), "output_path": F.lit(output_dir), **paths})


def build_splits(
    spark: SparkSession,
    input_dir: str,
    output_dir: str,
    spec: SplitSpec = SplitSpec(),
    overwrite: bool = False,
    complete_headers: bool = False,
    scratch_dir: str | None = None,
) -> DataFrame:
    """Label the collections and write train, context and target tables; returns a one-row summary.

    ``complete_headers=True`` says that every collection with interactions has a header row, as after
    :func:`ingest`; most train rows then need no join.
    """
    with layer(spark, output_dir, GOLD, overwrite) as staged, scratch(spark, scratch_dir) as root:
        silver = load_layer(spark, input_dir, ("playlists", "playlist_tracks"))
        interactions = silver["playlist_tracks"]
        labels = hash_split(collection_lengths(silver["playlists"], interactions), spec)
        splits = save_table(labels, staged, "playlist_splits")
        hidden = save_table(hidden_rows(interactions, splits, spec, splits_from_spec=True), root, "hidden")
        visible = save_table(visible_rows(interactions, hidden, spec, splits_from_spec=True), root, "visible")
        tables = {"train_playlist_tracks": train_interactions(interactions, splits, spec if complete_headers else None)}
        for name in EVALUATION:
            tables[f"{name}_context"] = visible_part(visible, name)
            tables[f"{name}_targets"] = hidden_part(hidden, name)
        save_tables(tables, staged)
        return held(_with_paths(split_summary(splits), input_dir, output_dir, GOLD))


def run_baselines(
    spark: SparkSession,
    input_dir: str,
    output_dir: str,
    ks: Iterable[int] | str = (10, 50, 100),
    full_data: bool = False,
    train_sample_size: int = 50_000,
    validation_sample_size: int = 5_000,
    seed: int = 42,
    hash_fn: str = "xxhash64",
    min_pair_support: int = 3,
    min_candidate_popularity: int = 5,
    overwrite: bool = False,
    scratch_dir: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Both recommenders on the validation split, scored; returns the metrics and a one-row summary."""
    cutoffs = validate_ks(ks)
    metrics_path = f"{output_dir.rstrip('/')}/{METRICS_FILE}"
    if not overwrite and exists(spark, output_dir) and exists(spark, metrics_path):
        raise FileExistsError(f"already written: {metrics_path}")
    sizes = (None, None) if full_data else (train_sample_size, validation_sample_size)
    with layer(spark, output_dir, ARTIFACTS, overwrite) as staged, scratch(spark, scratch_dir) as root:
        gold = load_layer(spark, input_dir, ("train_playlist_tracks", "validation_context", "validation_targets"))
        run = dict(zip(("train", "context", "targets"), restrict_run_tables(*gold.values(), *sizes, seed, hash_fn)))
        if not full_data:
            run = {name: save_table(rows, root, name) for name, rows in run.items()}
        train, context, targets = run.values()

        popularity = save_table(item_popularity(train, root), staged, "track_popularity")
        counts = cooccurrence_pairs(train, popularity, min_pair_support, min_candidate_popularity, root=root)
        pairs = save_table(counts, staged, "cooccurrence_pairs")
        both = recommendations_union(
            recommend_popular(context, popularity, max(cutoffs)),
            recommend_cooccurrence(context, pairs, max(cutoffs), root=root),
        )
        recommendations = save_table(both, staged, "validation_recommendations")
        metrics = held(ranking_metrics(recommendations, targets, cutoffs))
        write_text(spark, f"{staged}/{METRICS_FILE}", report_json(metrics))
        summary = _with_paths(run_summary(train, context, full_data), input_dir, output_dir, ARTIFACTS)
        summary = summary.withColumns(
            {
                "k_values": F.array(*[F.lit(k) for k in cutoffs]),
                "metrics_path": F.lit(metrics_path),
                "metrics": metrics_report(metrics).select("baselines").scalar(),
            }
        )
        return metrics, held(summary)
