from basketry.operators.cooccurrence import cooccurrence_pairs, recommend_cooccurrence, recommendations_union
from basketry.operators.flatten import flatten_collections, flatten_interactions, item_dimension
from basketry.operators.metrics import hits_and_dcg, ideal_dcg, metrics_report, ranking_metrics
from basketry.operators.popularity import item_popularity, popularity_candidates, recommend_popular
from basketry.operators.sampling import restrict_run_tables, sample_collections
from basketry.operators.splits import (
    SplitSpec,
    collection_lengths,
    hash_split,
    hidden_part,
    hidden_rows,
    holdout_budget,
    holdout_context,
    holdout_rank,
    holdout_targets,
    split_counts,
    train_interactions,
    visible_part,
    visible_rows,
)
from basketry.operators.summaries import ingest_summary, run_summary, split_summary

__all__ = [
    "SplitSpec",
    "collection_lengths",
    "cooccurrence_pairs",
    "flatten_collections",
    "flatten_interactions",
    "hash_split",
    "hidden_part",
    "hidden_rows",
    "hits_and_dcg",
    "holdout_budget",
    "holdout_context",
    "holdout_rank",
    "holdout_targets",
    "ideal_dcg",
    "ingest_summary",
    "item_dimension",
    "item_popularity",
    "metrics_report",
    "popularity_candidates",
    "ranking_metrics",
    "recommend_cooccurrence",
    "recommend_popular",
    "recommendations_union",
    "restrict_run_tables",
    "run_summary",
    "sample_collections",
    "split_counts",
    "split_summary",
    "train_interactions",
    "visible_part",
    "visible_rows",
]
