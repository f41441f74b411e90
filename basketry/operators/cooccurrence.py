"""Items bought together: pair counts and the recommender built on them."""

from __future__ import annotations

from dataclasses import dataclass
from uuid import uuid4

from pyspark.sql import Column, DataFrame, Window, functions as F

from basketry.functions.pairs import PACKED, pair_stripes, shelved, supported_pairs, unshelved
from basketry.functions.ranking import GIANT_ROWS, shuffle_tasks
from basketry.operators.popularity import HEAD_ITEMS, RECOMMENDATION, by_rank
from basketry.sources.tables import save_table, scratch_root

# Largest number of items of one collection that meet those of another block of it in one join key.
BLOCK_ITEMS = 1024
# Occurrences of an item for which its partners are divided over one more key when their support is added up.
PART_ROWS = 50_000
# Occurrences up to which an item is rare, so that its pairs travel with those of its neighbours by rank.
RARE_ROWS = 200
# Contexts, and pairs, of one item that meet in one join key: about a million votes.
BLOCK_ROWS = 1024
# Partners of an item, strongest first, that vote before it is known which collections need more.
SORTED_PARTNERS = 1000


def sized_items(train: DataFrame, block_items: int = BLOCK_ITEMS, giant_rows: int = GIANT_ROWS) -> DataFrame:
    """``pid, track_id, occurrences, most, blocks`` of the collections that hold two items or more.

    ``most``: the largest occurrence of an item in the collection. ``blocks``: of ``block_items`` items, how many it has.
    Rows travel once, to the task of their collection. Collections of ``giant_rows`` rows or more are dealt by item instead
    and meet their sizes in a join that Spark may divide. ``train`` is read twice: pass a written table.
    """
    known = train.where(F.col("track_id").isNotNull() & F.col("pid").isNotNull()).select("pid", "track_id")
    giants = known.groupBy("pid").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") >= giant_rows).select("pid")
    blocks = F.ceil(F.col("items") / F.lit(block_items)).cast("int").alias("blocks")
    result = ("pid", "track_id", "occurrences", "most", blocks)
    occurrences = F.count(F.lit(1)).alias("occurrences")

    def together(rows: DataFrame) -> DataFrame:
        collection = Window.partitionBy("pid")
        counted = rows.repartition(shuffle_tasks(rows), "pid").groupBy("pid", "track_id").agg(occurrences)
        sized = counted.withColumns({"items": F.count(F.lit(1)).over(collection), "most": F.max("occurrences").over(collection)})
        return sized.where(F.col("items") > 1).select(*result)

    if giants.isEmpty():
        return together(known)
    counted = known.join(giants, "pid", "left_semi").groupBy("pid", "track_id").agg(occurrences)
    # Reading "occurrences" keeps this the same shuffle as the one above, which Spark then runs once.
    items = F.count_if(F.col("occurrences") > 0)
    sizes = counted.groupBy("pid").agg(items.alias("items"), F.max("occurrences").alias("most"))
    apart = counted.join(sizes.where(F.col("items") > 1), "pid").select(*result)
    return together(known.join(giants, "pid", "left_anti")).unionByName(apart)


def _bound() -> Column:
    """Decimal, as a product of counts may pass 64 bits."""
    product = F.col("occurrences").cast("decimal(19,0)") * F.col("most").cast("decimal(19,0)")
    return F.sum(product.cast("decimal(28,0)"))


def support_bounds(sized: DataFrame) -> DataFrame:
    """``track_id, bound``: no pair with the item can have more support.

    An item meets another one in a collection at most as often as its own occurrences times the collection's largest.
    """
    return sized.groupBy("track_id").agg(_bound().alias("bound"))


def _able_items(sized: DataFrame, popularity: DataFrame, min_pair_support: int, head_items: int) -> DataFrame:
    """``sized`` with rank and frequency, without items whose pairs cannot reach the support.

    An item of the broadcast head that occurs often enough is taken as it is. The bounds of all others are summed where
    the shuffled tail of the popularity table has brought their rows together; what has no rank then is an error.
    """
    in_head, often = F.col("popularity_rank") <= head_items, F.col("train_frequency") >= min_pair_support
    looked_up = popularity.select("track_id", "popularity_rank", "train_frequency")
    near = sized.join(F.broadcast(looked_up.where(in_head & often)), "track_id", "left")
    found = F.col("popularity_rank").isNotNull()
    far = near.where(~found).select(*sized.columns).join(looked_up.where(~(in_head & often)), "track_id", "left")
    far = far.withColumn("bound", _bound().over(Window.partitionBy("track_id"))).where(F.col("bound") >= min_pair_support).drop("bound")
    uncovered = F.raise_error(F.concat(F.lit("popularity has no row for the item "), F.col("track_id").cast("string")))
    far = far.withColumn("popularity_rank", F.coalesce("popularity_rank", uncovered.cast("bigint")))
    return near.where(found).unionByName(far)


def cooccurrence_pairs(
    train: DataFrame,
    popularity: DataFrame,
    min_pair_support: int = 3,
    min_candidate_popularity: int = 5,
    block_items: int = BLOCK_ITEMS,
    head_items: int = HEAD_ITEMS,
    root: str | None = None,
) -> DataFrame:
    """``context_track_id, candidate_track_id, pair_support, candidate_popularity`` of ordered item pairs.

    Support is the number of (context, candidate) occurrence pairs over all collections. ``popularity``, a written
    table, has to cover the items of ``train``; an item without a rank is an error, not a pair that is silently missing.

    * Repeats inside a collection are counted once and weigh in by multiplication.
    * An item whose pairs cannot reach the support (:func:`support_bounds`) is left out before any pair is made.
    * Items travel as their popularity rank, two numbers per pair whatever the type of the ids.
    * Support is symmetric, so each unordered pair is counted once, more popular item first; an item below
      the popularity floor can then only be the second one. Both directions are written after the count.
    * The rows of a collection meet in one task, sorted. A task adds up the pairs it makes and sends them as stripes:
      the rarer item with a list of its partners, so that a pair costs one number and not a row. Rare items share
      stripes with their neighbours by rank, and numbers travel as the steps between them. The tasks of the
      rarer items add up the stripes and give the pairs with enough support.
    * A collection of n items makes n * n comparisons. Beyond ``block_items`` items they are divided over
      (block, block) keys, so the work of one key is bounded; all pairs of blocks meet.
    """
    root = root or scratch_root(train.sparkSession)
    sized = save_table(sized_items(train, block_items), root, f"sized-{uuid4().hex}")
    able = _able_items(sized, popularity, min_pair_support, head_items)
    leads = F.when(F.col("train_frequency") >= min_candidate_popularity, 1).otherwise(0)
    parts = F.ceil(F.col("train_frequency") / F.lit(PART_ROWS)).cast("int").alias("parts")
    own = F.pmod(F.xxhash64("popularity_rank"), F.col("blocks")).cast("int")

    def side(block_a: Column, block_b: Column, leads: Column, follows: int) -> Column:
        return F.struct(block_a.alias("block_a"), block_b.alias("block_b"), leads.alias("leads"), F.lit(follows).alias("follows"))

    # A row of a small collection is either side of its pairs; one of a large collection goes to all blocks it has to meet.
    nowhere = F.lit(0)
    all_blocks = F.sequence(F.lit(0), F.col("blocks") - 1)
    both = F.array(side(nowhere, nowhere, leads, 1))
    each = F.flatten(F.transform(all_blocks, lambda other: F.array(side(own, other, leads, 0), side(other, own, nowhere, 1))))
    sides = F.inline(F.when(F.col("blocks") == 1, both).otherwise(each))
    placed = able.select("pid", F.col("popularity_rank").alias("rank"), F.col("occurrences").alias("times"), parts, sides)
    # A step that multiplies its rows uses all partitions, whatever the size of its inputs suggests.
    tasks = shuffle_tasks(train)
    keys = ["pid", "block_a", "block_b"]
    starts = F.row_number().over(Window.partitionBy(*keys).orderBy("rank")) == 1
    narrow = popularity.where(F.col("popularity_rank") >= PACKED).isEmpty()
    lone = popularity.where(F.col("train_frequency") > RARE_ROWS).agg(F.coalesce(F.max("popularity_rank"), F.lit(0))).first()[0]
    stripes = placed.repartition(tasks, *keys).select(starts.alias("starts"), "rank", "times", "leads", "follows", "parts").mapInArrow(
        shelved(pair_stripes(narrow), lone), "b bigint, part int, lows binary, others binary, supports binary"
    )
    sorted_stripes = stripes.repartition(tasks, "b", "part").sortWithinPartitions("b", "part")
    # Only the portions of a very large (b, part) are still to be added up.
    support = (
        sorted_stripes.mapInArrow(unshelved(supported_pairs(min_pair_support), lone), "a bigint, b bigint, pair_support bigint")
        .groupBy("a", "b")
        .agg(F.sum("pair_support").alias("pair_support"))
        .where(F.col("pair_support") >= min_pair_support)
    )
    directed = support.select(
        F.inline(
            F.array(
                F.struct(F.col("b").alias("context_rank"), F.col("a").alias("candidate_rank")),
                F.struct(F.col("a").alias("context_rank"), F.col("b").alias("candidate_rank")),
            )
        ),
        "pair_support",
    )
    # Low ranks have most partners; they are the broadcast head of either lookup.
    candidates = popularity.where(F.col("train_frequency") >= min_candidate_popularity).select(
        "popularity_rank",
        F.col("track_id").alias("candidate_track_id"),
        F.col("train_frequency").alias("candidate_popularity"),
    )
    contexts = popularity.select("popularity_rank", F.col("track_id").alias("context_track_id"))
    named = by_rank(by_rank(directed, "candidate_rank", candidates, head_items), "context_rank", contexts, head_items)
    return named.select("context_track_id", "candidate_track_id", "pair_support", "candidate_popularity")


def _votes(weights: DataFrame, partners: DataFrame, block_rows: int) -> DataFrame:
    """``pid, track_id, votes, candidate_popularity``: each item of a context with each of its ``partners``.

    An item in w contexts and d pairs takes part in w * d votes. Either side is divided into blocks of about
    ``block_rows`` rows and all blocks meet, so the votes of a frequent item are spread over many tasks.
    """

    def block_counts(rows: DataFrame, into: str) -> DataFrame:
        """How many blocks an item needs, where it needs more than one."""
        blocks = F.ceil(F.count(F.lit(1)) / F.lit(block_rows)).cast("int")
        return rows.groupBy("track_id").agg(blocks.alias(into)).where(F.col(into) > 1)

    blocks = block_counts(weights, "context_blocks").join(block_counts(partners, "pair_blocks"), "track_id", "full")

    def placed(rows: DataFrame, by: str, own: str, other: str) -> DataFrame:
        # Spark broadcasts a small table of blocks, else it divides the hot items of the join.
        counted = rows.join(blocks, "track_id", "left").withColumns(
            {name: F.coalesce(f"{name}_blocks", F.lit(1)) for name in ("context", "pair")}
        )
        return counted.select(
            *rows.columns,
            F.pmod(F.xxhash64(by), F.col(own)).cast("int").alias(f"{own}_block"),
            F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(f"{other}_block"),
        )

    keys = ["track_id", "context_block", "pair_block"]
    tasks = shuffle_tasks(weights)
    return (
        placed(weights, "pid", "context", "pair")
        .repartition(tasks, *keys)
        .join(placed(partners, "candidate_track_id", "pair", "context").repartition(tasks, *keys), keys)
        .select(
            "pid",
            F.col("candidate_track_id").alias("track_id"),
            (F.col("occurrences") * F.col("pair_support")).alias("votes"),
            "candidate_popularity",
        )
    )


def _scores(votes: DataFrame, known: DataFrame) -> DataFrame:
    """``pid, track_id, votes, candidate_popularity`` of the items that are not in the collection.

    The context itself enters the same aggregation as rows without votes: one shuffle and no join finds both the
    scores and the items to leave out.
    """
    nothing = F.lit(None).cast("bigint")
    own = known.select("pid", "track_id", nothing.alias("votes"), nothing.alias("candidate_popularity"))
    return (
        votes.withColumn("seen", F.lit(0))
        .unionByName(own.withColumn("seen", F.lit(1)))
        .groupBy("pid", "track_id")
        .agg(
            F.sum("votes").alias("votes"),
            F.max("candidate_popularity").alias("candidate_popularity"),
            F.max("seen").alias("seen"),
        )
        .where(F.col("seen") == 0)
        .drop("seen")
    )


_BEST_FIRST = (F.desc, "votes"), (F.desc, "candidate_popularity"), (F.asc, "track_id")


def _top(scores: DataFrame, max_k: int) -> DataFrame:
    """The first ``max_k`` of each collection with their ``rank``; Spark cuts them before the shuffle too."""
    best_first = Window.partitionBy("pid").orderBy(*(f(c) for f, c in _BEST_FIRST))
    return scores.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= max_k)


@dataclass(frozen=True)
class VoteSteps:
    """The tables of an early end: what each step compares is there to be counted."""

    #: ``track_id`` of the items with more partners than voted at first, and the support that the next one has at most.
    cut_items: DataFrame
    #: Votes of the strongest partners.
    first: DataFrame
    #: Collections that the first votes settle but for the exact scores of some candidates.
    settled: DataFrame
    #: Those candidates, with the votes they have.
    contenders: DataFrame
    #: Votes of weaker partners for them.
    looked_up: DataFrame
    #: Votes of all partners in the other collections.
    rest: DataFrame


def vote_steps(weights: DataFrame, known: DataFrame, partners: DataFrame, max_k: int, depth: int, block_rows: int, root: str) -> VoteSteps | None:
    """A threshold algorithm over partners sorted by support; None if no item has more than ``depth`` of them.

    Of each item the ``depth`` strongest partners vote first. What a collection's items have left out bounds what any
    candidate can still gain there: occurrences times the support of the first partner left out, summed. If the
    ``max_k``-th best candidate is above that, no candidate without a vote can reach the list; and of those with votes only
    the ones within the bound of it are scored in full, by looking up the collection's items. All other collections vote
    in full.
    """
    sorted_partners = Window.partitionBy("track_id").orderBy(F.desc("pair_support"), "candidate_track_id")
    ranked = partners.withColumn("place", F.row_number().over(sorted_partners)).where(F.col("place") <= depth + 1)
    ranked = save_table(ranked, root, f"strongest-{uuid4().hex}")
    cut = ranked.where(F.col("place") == depth + 1).select("track_id", F.col("pair_support").alias("next_support"), F.col("candidate_track_id").alias("next_partner"))
    if cut.isEmpty():
        return None
    strongest = ranked.where(F.col("place") <= depth).select(*partners.columns)
    first = _votes(weights, strongest, block_rows)
    partial = save_table(_scores(first, known), root, f"partial-{uuid4().hex}")
    gain = weights.join(cut, "track_id").groupBy("pid").agg(F.sum(F.col("occurrences") * F.col("next_support")).alias("gain"))
    gain = save_table(gain, root, f"gain-{uuid4().hex}")
    last = _top(partial, max_k).where(F.col("rank") == max_k).select("pid", F.col("votes").alias("last_votes"))
    bounds = known.select("pid").distinct().join(gain, "pid", "left").join(last, "pid", "left").withColumn("gain", F.coalesce("gain", F.lit(0)))
    bounds = bounds.withColumn("settled", (F.col("gain") == 0) | F.coalesce(F.col("last_votes") > F.col("gain"), F.lit(False)))
    bounds = save_table(bounds, root, f"bounds-{uuid4().hex}")
    settled = bounds.where("settled")
    near = F.col("last_votes").isNull() | (F.col("votes") + F.col("gain") >= F.col("last_votes"))
    contenders = partial.join(settled, "pid").where(near).select("pid", "track_id", "votes", "candidate_popularity")
    contenders = save_table(contenders, root, f"contenders-{uuid4().hex}")
    # What the contenders have yet to get: from items with partners left out, those partners.
    left_out = (F.col("pair_support") < F.col("next_support")) | (
        (F.col("pair_support") == F.col("next_support")) & (F.col("candidate_track_id") >= F.col("next_partner"))
    )
    weaker = partners.join(cut, "track_id").where(left_out).select(F.col("track_id").alias("of_item"), F.col("candidate_track_id").alias("track_id"), "pair_support", "candidate_popularity")
    of_cut = weights.join(cut.select("track_id"), "track_id", "left_semi").withColumnRenamed("track_id", "of_item")
    asked = contenders.select("pid", "track_id").join(settled.where("gain > 0").select("pid"), "pid", "left_semi")
    looked_up = asked.join(of_cut, "pid").join(weaker, ["of_item", "track_id"])
    looked_up = looked_up.select("pid", "track_id", (F.col("occurrences") * F.col("pair_support")).alias("votes"), "candidate_popularity")
    rest = _votes(weights.join(bounds.where("NOT settled").select("pid"), "pid", "left_semi"), partners, block_rows)
    return VoteSteps(cut, first, settled, contenders, looked_up, rest)


def recommend_cooccurrence(
    context: DataFrame, pairs: DataFrame, max_k: int, block_rows: int = BLOCK_ROWS, depth: int = SORTED_PARTNERS, root: str | None = None
) -> DataFrame:
    """Per collection the ``max_k`` unseen items with the largest summed support from its context.

    An item occurring twice in the context counts twice. Ties go to the more popular, then the lower id. Where items
    have more than ``depth`` partners, :func:`vote_steps` ends early where the result is certain; no list is cut short
    elsewhere. Both inputs are read several times: pass written tables.
    """
    root = root or scratch_root(context.sparkSession)
    known = context.where(F.col("track_id").isNotNull() & F.col("pid").isNotNull())
    weights = known.groupBy("pid", "track_id").agg(F.count(F.lit(1)).alias("occurrences"))
    partners = pairs.withColumnRenamed("context_track_id", "track_id")
    many = partners.groupBy("track_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > depth)
    steps = None if many.isEmpty() else vote_steps(weights, known, partners, max_k, depth, block_rows, root)
    if steps is None:
        scores = _scores(_votes(weights, partners, block_rows), known)
    else:
        scores = _scores(steps.contenders.unionByName(steps.looked_up).unionByName(steps.rest), known)
    return (
        _top(scores, max_k)
        .withColumn("baseline_name", F.lit("cooccurrence"))
        .withColumn("score", F.col("votes").cast("double"))
        .select(*RECOMMENDATION)
    )


def recommendations_union(*recommendations: DataFrame) -> DataFrame:
    """All recommenders in one table, matched by column name."""
    first, *others = (r.select(*RECOMMENDATION) for r in recommendations)
    for other in others:
        first = first.unionByName(other)
    return first
