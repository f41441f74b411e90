"""Mixing sources to target weights by the cube method of balanced sampling.

The copies of a document that a mix takes are the whole part of its source's ratio target / size, and at most one
more, drawn with the fraction that is left. The draw is balanced: in its flight, three undecided units at a time move
along the one direction that changes neither the tokens nor the number of documents taken, until one of them is
decided. Two units stay undecided in a bucket of a source, and the few left of all buckets fly on together. At the end
a source has a dozen units left, which land on the choice nearest to the expected tokens and count.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil
from random import Random

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from basketry.llm.common import WORD, fresh_names, whole
from basketry.sources.tables import save_table, scratch_root

WEIGHTS = (3, 1, 2)
SHARE = 1.5
LIMIT = 2.0
#: Units that one task's bucket holds; larger sources have more buckets.
BUCKET = 1000
#: Units of a source that wait for its landing, next to the two that a flight leaves.
RESERVE = 10
_CLOSE = 1e-9
# What one document too many costs in the landing, in mean sizes of a document.
_COUNT_COST = 0.02


def word_count(text: str) -> Column:
    return F.regexp_count(whole(text), F.lit(WORD)).cast("bigint")


def source_targets(sized: DataFrame, root: str, weights: Sequence[float] = WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """One row per source of ``sized`` (``source``, ``size``): ``source``, ``rank``, ``rows``, ``source_size``, ``target``.

    The sources in code point order, null last, weigh ``weights`` in turn. They share ``share`` times all sizes by
    weight; a target stops at ``limit`` times its source's size and the excess is shared again until none is above.
    Ranks are counted inside ranges of sources, so no task holds all sources; the level of the shares is found by
    aggregates of which the driver sees two numbers.
    """
    spark = sized.sparkSession
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    ranges = totals.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id())
    ranges = save_table(ranges, root, "source-ranges")
    counts = sorted(ranges.groupBy("part").count().collect())  # a row for each shuffle partition
    starts = np.cumsum([0, *(n for _, n in counts)])
    offsets = spark.createDataFrame(
        [(part, int(start)) for (part, _), start in zip(counts, starts, strict=False)], "part int, start bigint"
    )
    order = Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())
    ranked = ranges.withColumn("at", F.row_number().over(order) - 1).join(F.broadcast(offsets), "part")
    ranked = ranked.select("source", (F.col("start") + F.col("at")).alias("rank"), "rows", "source_size")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = save_table(ranked.withColumn("weight", weight), root, "sources")
    most = F.col("source_size") * F.lit(float(limit))
    level, stopped = 0.0, -1
    while True:
        at = F.col("weight") * F.lit(level) > most
        total, taken, free, now = ranked.agg(
            F.coalesce(F.sum("source_size"), F.lit(0)),
            F.coalesce(F.sum(F.when(at, most)), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~at, F.col("weight"))), F.lit(0.0)),
            F.count(F.when(at, 1)),
        ).first()
        if now == stopped or not free:
            break
        level, stopped = (share * total - taken) / free, now
    target = F.least(F.col("weight") * F.lit(level), most)
    return ranked.select("source", "rank", "rows", "source_size", target.alias("target"))


def _flight(tokens: list[float], counts: list[float], chances: list[float], draw: Random) -> list[float]:
    """Move ``chances`` until at most two lie strictly between 0 and 1; tokens and counts keep their expectations."""
    chances = list(chances)
    active: list[int] = []
    for unit in range(len(chances)):
        active.append(unit)
        while len(active) == 3:
            (a, b, c) = active
            move = [
                tokens[b] * counts[c] - tokens[c] * counts[b],
                tokens[c] * counts[a] - tokens[a] * counts[c],
                tokens[a] * counts[b] - tokens[b] * counts[a],
            ]
            if not any(move):  # tokens in proportion to counts: two units are enough
                move = [counts[b], -counts[a], 0.0]
            up = down = float("inf")
            for u, m in zip(active, move, strict=True):
                if m > 0:
                    up, down = min(up, (1 - chances[u]) / m), min(down, chances[u] / m)
                elif m < 0:
                    up, down = min(up, chances[u] / -m), min(down, (1 - chances[u]) / -m)
            step = up if draw.random() * (up + down) < down else -down
            for u, m in zip(active, move, strict=True):
                chances[u] += step * m
                if chances[u] < _CLOSE or chances[u] > 1 - _CLOSE:
                    chances[u] = float(round(chances[u]))
            kept = [u for u in active if 0 < chances[u] < 1]
            if len(kept) == 3:  # rounding kept the unit at the border from reaching it
                nearest = min(active, key=lambda u: min(chances[u], 1 - chances[u]))
                chances[nearest] = float(round(chances[nearest]))
                kept.remove(nearest)
            active = kept
    return chances


def _landing(tokens: list[float], counts: list[float], chances: list[float]) -> list[float]:
    """Decide what is left by trying every choice: tokens nearest to what was expected, then the count."""
    left = [u for u, p in enumerate(chances) if 0 < p < 1]
    if not left:
        return chances
    choices = (np.arange(2 ** len(left))[:, None] >> np.arange(len(left))) & 1
    moved = choices - np.array([chances[u] for u in left])
    sizes, numbers = np.array([tokens[u] for u in left]), np.array([counts[u] for u in left])
    cost = np.abs(moved @ sizes) + _COUNT_COST * sizes.mean() * np.abs(moved @ numbers)
    decided = list(chances)
    for u, x in zip(left, choices[int(np.argmin(cost))], strict=True):
        decided[u] = float(x)
    return decided


def _last_flight(tokens: list[float], counts: list[float], chances: list[float], draw: Random) -> list[float]:
    """Fly and land; ``RESERVE`` units of all sizes wait for the landing, which they make finer."""
    n = len(chances)
    waiting = set(np.linspace(0, n - 1, min(n, RESERVE)).astype(int).tolist())
    flying = [u for u in range(n) if u not in waiting]
    chances = list(chances)
    moved = _flight([tokens[u] for u in flying], [counts[u] for u in flying], [chances[u] for u in flying], draw)
    for u, p in zip(flying, moved, strict=True):
        chances[u] = p
    return _landing(tokens, counts, chances)


def _fly(seed: int, level: int, last: bool):
    def fly(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["tokens", "order", "key"], ascending=[False, True, True], kind="stable")
        tokens, counts = rows["tokens"].astype(float).tolist(), rows["n"].astype(float).tolist()
        draw = Random(f"{seed} {level} {rows['rank'].iloc[0]} {rows['bucket'].iloc[0]}")
        step = _last_flight if last else _flight
        return rows.assign(chance=step(tokens, counts, rows["chance"].tolist(), draw))

    return fly


def mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    limit: float = LIMIT,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``size``, ``source``, ``source_size``, ``target``, ``copies``, ``taken``.

    ``size`` counts words, null text has none; ``taken`` is ``copies`` times ``size``. Null is a source of its own,
    the last. Rows that share id, source and size are one unit with one decision. A source without words has the
    target 0; an empty table gives an empty result. Reruns agree: buckets and draws follow from ids and ``seed``.
    """
    root = scratch_root(docs.sparkSession)
    sized = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(text_col).alias("size")
    )
    units = sized.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n"))
    units = save_table(units, root, "units")
    rows = units.select("source", (F.col("size") * F.col("n")).alias("size"))
    targets = save_table(source_targets(rows, root, weights, share, limit), root, "targets")
    named = targets.withColumnRenamed("source", "of")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    units = (
        units.join(named, units["source"].eqNullSafe(named["of"]))
        .drop("of")
        .withColumn("whole", F.floor(ratio))
        .withColumn("chance", ratio - F.floor(ratio))
        .withColumn("tokens", F.col("size") * F.col("n"))
        .withColumn("order", F.xxhash64(F.lit(seed), "doc_id"))
        .withColumn("key", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    )
    undecided = units.where((F.col("chance") > 0) & (F.col("chance") < 1))
    decided = units.where((F.col("chance") <= 0) | (F.col("chance") >= 1))
    names = units.columns
    buckets = F.ceil(F.col("rows") / BUCKET)
    most = targets.agg(F.max("rows")).first()[0] or 0
    flown, level = [decided], 0
    while True:
        last = most <= BUCKET
        bucket = F.pmod(F.xxhash64(F.lit(level), "order"), F.greatest(buckets, F.lit(1)))
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in units.schema) + ", bucket bigint"
        result = undecided.withColumn("bucket", bucket).groupBy("rank", "bucket").applyInPandas(_fly(seed, level, last), schema)
        result = save_table(result.select(*names), root, f"flight-{level}")
        if last:
            flown.append(result)
            break
        border = (F.col("chance") > 0) & (F.col("chance") < 1)
        flown.append(result.where(~border))
        # What a source has left now: two units in each of its buckets at most.
        undecided = result.where(border).withColumn("rows", F.least("rows", 2 * buckets))
        most, level = max(2 * ceil(most / BUCKET), 1), level + 1
    every = flown[0]
    for part in flown[1:]:
        every = every.union(part)
    copies = (F.col("whole") + F.round("chance")).cast("bigint")
    return every.withColumn("repeat", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n")))).select(
        "doc_id", "size", "source", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: the rows of ``docs`` with all columns, a document of two copies twice, of none not at all.

    The columns may have any names. How often a document is taken, and what null ids, texts and sources mean, is told by
    :func:`mix`; rows that repeat an id, source and size share one verdict. An empty table gives an empty result.
    """
    decided = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    taken = decided.where(F.col("copies") > 0).select("doc_id", "source", "size", "copies").distinct()
    own_id, source, size, copies, words, copy = fresh_names(docs, 6)
    taken = taken.toDF(own_id, source, size, copies)
    keyed = docs.withColumn(words, word_count(text_col))
    same = F.col(id_col).eqNullSafe(F.col(own_id)) & F.col(source_col).eqNullSafe(F.col(source)) & (F.col(words) == F.col(size))
    joined = keyed.join(taken, same).withColumn(copy, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(copies))))
    return joined.drop(own_id, source, size, copies, words, copy)
