"""Deterministic train / validation / test labels, and the hidden part of each evaluation collection."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from uuid import uuid4

from pyspark.sql import Column, DataFrame, Window, functions as F

from basketry.functions.checks import validate_ratios
from basketry.functions.hashing import MODULUS, hash_score
from basketry.functions.ranking import GIANT_ROWS, group_rank, same_keys
from basketry.sources.tables import save_table, scratch_root

INTERACTION = ("pid", "pos", "track_id", "artist_id", "album_id", "duration_ms")
EVALUATION = ("validation", "test")


@dataclass(frozen=True)
class SplitSpec:
    """All parameters of a split; one value goes to every operator that has to agree on them.

    ``exact_mask_scores=False`` rounds the 64-bit mask hash to a double before taking the remainder: more ties,
    which low positions win. ``True`` keeps the hash exact. The md5 hash is the same either way.
    """

    train_ratio: float = 0.90
    validation_ratio: float = 0.05
    test_ratio: float = 0.05
    seed: int = 42
    min_length: int = 5
    mask_fraction: float = 0.20
    max_hidden: int = 10
    hash_fn: str = "xxhash64"
    exact_mask_scores: bool = False

    def __post_init__(self) -> None:
        validate_ratios(self.train_ratio, self.validation_ratio, self.test_ratio)

    def split_score(self) -> Column:
        return hash_score(self.seed, "pid", hash_fn=self.hash_fn) / F.lit(float(MODULUS))

    def hash_label(self) -> Column:
        """Label by hash alone, as if every collection were long enough."""
        score = self.split_score()
        return (
            F.when(score < F.lit(self.train_ratio), "train")
            .when(score < F.lit(self.train_ratio + self.validation_ratio), "validation")
            .otherwise("test")
        )

    def mask_score(self) -> Column:
        modulus = MODULUS if self.exact_mask_scores else float(MODULUS)
        return hash_score(self.seed, "split", "pid", "pos", hash_fn=self.hash_fn, modulus=modulus)


def collection_lengths(collections: DataFrame, interactions: DataFrame) -> DataFrame:
    """``pid, playlist_length`` of every collection: counted, else as declared in ``num_tracks``, else 0."""
    counted = interactions.groupBy("pid").agg(F.count(F.lit(1)).alias("counted"))
    return (
        collections.select(F.col("pid").cast("bigint"), F.col("num_tracks").cast("bigint").alias("declared"))
        .join(counted, "pid", "left")
        .select("pid", F.coalesce("counted", "declared", F.lit(0)).alias("playlist_length"))
    )


def hash_split(lengths: DataFrame, spec: SplitSpec) -> DataFrame:
    """Label each collection; those shorter than ``min_length`` are always train."""
    too_short = F.col("playlist_length") < spec.min_length
    return lengths.withColumn("split", F.when(too_short, "train").otherwise(spec.hash_label())).select(
        "pid", "split", "playlist_length", F.col("split").isin(*EVALUATION).alias("eligible_for_eval")
    )


def train_interactions(interactions: DataFrame, splits: DataFrame, spec: SplitSpec | None = None) -> DataFrame:
    """Interactions of the train collections.

    With the ``spec`` that made ``splits``, rows whose hash alone says train skip the join: nine in ten by
    default. Pass it only where every pid of ``interactions`` has a row in ``splits``.
    """
    rows = interactions.select(*INTERACTION)
    members = splits.where(F.col("split") == "train").select("pid")
    if spec is None:
        return rows.join(members, "pid", "left_semi")
    by_hash = spec.hash_label() == "train"
    too_short = members.where(~by_hash)
    return rows.where(by_hash).unionByName(rows.where(~by_hash).join(too_short, "pid", "left_semi"))


def holdout_budget(splits: DataFrame, spec: SplitSpec) -> DataFrame:
    """How many occurrences to hide per evaluation collection: at least 1, at most ``max_hidden``."""
    share = F.ceil(F.col("playlist_length") * F.lit(spec.mask_fraction))
    hidden = F.least(F.lit(spec.max_hidden), F.greatest(F.lit(1), share)).cast("int")
    return (
        splits.where(F.col("split").isin(*EVALUATION))
        .groupBy("pid", "split")
        .agg(F.max("playlist_length").alias("playlist_length"))
        .withColumn("hidden_count", hidden)
    )


def _evaluation_rows(interactions: DataFrame, spec: SplitSpec, names: Sequence[str], splits_from_spec: bool) -> DataFrame:
    """Interactions that may be of a collection of the splits ``names``."""
    rows = interactions.select(*INTERACTION)
    return rows.where(spec.hash_label().isin(*names)) if splits_from_spec else rows


# A total order: rows that tie on all of it are copies of one another.
MASK_ORDER = ("mask_score", "pos", "track_id", "artist_id", "album_id", "duration_ms")


def holdout_rank(
    interactions: DataFrame,
    splits: DataFrame,
    spec: SplitSpec,
    names: Sequence[str] = EVALUATION,
    splits_from_spec: bool = False,
    giant_rows: int = GIANT_ROWS,
    root: str | None = None,
) -> DataFrame:
    """Interactions of the evaluation collections with a pseudo-random rank inside each collection.

    ``splits_from_spec=True`` says that :func:`hash_split` made ``splits`` with this ``spec``. The hash then
    drops the rows of all other collections before the join, so that only evaluation rows are shuffled.

    Collections of ``giant_rows`` items or more are ranked by ranges, the others by a window on the partitioning that
    the join has made. ``splits`` is read twice, once to find the giants: pass a written table if it is dear to make.
    Where only the hidden or the visible part is wanted, :func:`hidden_rows` and :func:`visible_rows` rank nothing else.
    """
    root = root or scratch_root(interactions.sparkSession)
    budget = holdout_budget(splits.where(F.col("split").isin(*names)), spec)
    giants = save_table(budget.where(F.col("playlist_length") >= giant_rows).select("pid").distinct(), root, f"giants-{uuid4().hex}")
    rows = _evaluation_rows(interactions, spec, names, splits_from_spec)
    judged = rows.join(budget.select("pid", "split", "hidden_count"), "pid").withColumn("mask_score", spec.mask_score())
    order = [F.col(c) for c in MASK_ORDER]
    ranked = group_rank(judged, ["pid"], order, "mask_rank", giants, root)
    return ranked.select(*INTERACTION, "split", "hidden_count", "mask_score", "mask_rank")


def holdout_context(ranked: DataFrame, name: str) -> DataFrame:
    """The visible part of the collections of one split, from :func:`holdout_rank`."""
    return ranked.where((F.col("split") == name) & (F.col("mask_rank") > F.col("hidden_count"))).select(*INTERACTION)


def hidden_rows(
    interactions: DataFrame,
    splits: DataFrame,
    spec: SplitSpec,
    names: Sequence[str] = EVALUATION,
    splits_from_spec: bool = False,
) -> DataFrame:
    """The rows of :func:`holdout_rank` that are hidden, without ranking the rest.

    Only the first ``max_hidden`` ranks matter, so rows are scored and cut before they meet the budget. Spark applies
    the literal bound before the shuffle: a collection of any size reaches its task as a few rows per partition.
    """
    budget = holdout_budget(splits.where(F.col("split").isin(*names)), spec).select("pid", "split", "hidden_count")
    rows = _evaluation_rows(interactions, spec, names, splits_from_spec).where(F.col("pid").isNotNull())
    # The score depends on the split: the hash tells it, or else each is scored for itself.
    if splits_from_spec:
        labelled = rows.withColumn("split", spec.hash_label())
    else:
        labelled = rows.withColumn("split", F.explode(F.array(*(F.lit(n) for n in names))))
    order = Window.partitionBy("pid", "split").orderBy(*MASK_ORDER)
    first = (
        labelled.withColumn("mask_score", spec.mask_score())
        .withColumn("mask_rank", F.row_number().over(order))
        .where(F.col("mask_rank") <= spec.max_hidden)
    )
    return (
        first.join(budget, ["pid", "split"])
        .where(F.col("mask_rank") <= F.col("hidden_count"))
        .select(*INTERACTION, "split", "hidden_count", "mask_score", F.col("mask_rank").cast("bigint").alias("mask_rank"))
    )


def mask_cutoffs(hidden: DataFrame) -> DataFrame:
    """``pid, split, cutoff, hidden_copies``: the last hidden row of each collection, as the struct of ``MASK_ORDER``.

    ``hidden_copies``: how many hidden rows are equal to it; rows that repeat each other may be parted by the cut. Of a
    collection at most ``max_hidden`` rows are gathered.
    """
    keys = F.collect_list(F.struct(*MASK_ORDER))
    return (
        hidden.groupBy("pid", "split")
        .agg(keys.alias("keys"))
        .withColumn("cutoff", F.array_max("keys"))
        .select("pid", "split", "cutoff", F.size(F.filter("keys", lambda k: k == F.array_max("keys"))).alias("hidden_copies"))
    )


def visible_rows(
    interactions: DataFrame,
    hidden: DataFrame,
    spec: SplitSpec,
    names: Sequence[str] = EVALUATION,
    splits_from_spec: bool = False,
) -> DataFrame:
    """``split`` and the rows of its collections that :func:`hidden_rows` has left: those beyond the collection's cut-off.

    No row is ranked. A collection meets one cut-off, in a join that Spark may broadcast or, where a collection is
    giant, divide: its rows need no order and no company. ``hidden`` is read more than once: pass a written table.
    """
    rows = _evaluation_rows(interactions, spec, names, splits_from_spec)
    cuts = mask_cutoffs(hidden.where(F.col("split").isin(*names)))
    key = F.struct(*MASK_ORDER)
    beyond = rows.join(cuts, "pid").withColumn("mask_score", spec.mask_score()).where(key > F.col("cutoff"))
    # Copies of the last hidden row, of which only as many are hidden as were ranked. They meet it by all they hold, so
    # that nothing hinders Spark from dividing the join above.
    last = cuts.select(F.col("pid").alias("of"), "split", "hidden_copies", *(F.col(f"cutoff.{c}").alias(f"last_{c}") for c in MASK_ORDER[1:]))
    same = same_keys(("pid", *MASK_ORDER[1:]), ("of", *(f"last_{c}" for c in MASK_ORDER[1:])))
    copies = rows.join(last, same).groupBy("split", "hidden_copies", *INTERACTION).agg(F.count(F.lit(1)).alias("copies"))
    spare = F.explode(F.array_repeat(F.lit(1), (F.col("copies") - F.col("hidden_copies")).cast("int")))
    rest = copies.where(F.col("copies") > F.col("hidden_copies")).select("split", *INTERACTION, spare.alias("copy")).drop("copy")
    return beyond.select("split", *INTERACTION).unionByName(rest)


def holdout_targets(
    interactions: DataFrame, splits: DataFrame, spec: SplitSpec, name: str, splits_from_spec: bool = False
) -> DataFrame:
    """The hidden part of the collections of one split, without ranking the rest."""
    return hidden_part(hidden_rows(interactions, splits, spec, [name], splits_from_spec), name)


def hidden_part(ranked: DataFrame, name: str) -> DataFrame:
    """The hidden rows of one split among ranked ones that carry their collection's ``hidden_count``."""
    return ranked.where((F.col("split") == name) & (F.col("mask_rank") <= F.col("hidden_count"))).select(*INTERACTION)


def visible_part(visible: DataFrame, name: str) -> DataFrame:
    """The rows of one split among those of :func:`visible_rows`."""
    return visible.where(F.col("split") == name).select(*INTERACTION)


def split_counts(splits: DataFrame) -> DataFrame:
    return splits.groupBy("split").agg(F.count(F.lit(1)).alias("playlists"))
