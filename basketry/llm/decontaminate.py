"""Benchmark decontamination by greedy string tiling: passages are found although their parts are reordered.

Seeds are runs of ``MIN_TILE`` words that a document shares with a test, or a whole test that is shorter. Every tile
consists of seeds, so only the stretches of a document whose seeds may occur in a test go on. A document meets a test
by the test's rarest seeds: those around a few of its words more than may stay uncovered, one of which any tiling that
reaches the threshold has to cover. The pairs are tiled: the longest free common runs, found by running Karp-Rabin
hashes, are marked again and again, and the tiles' share of the test decides.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from basketry.llm.common import WordHashes, fresh_names, in_filter, mixed, set_filter, shingle_hashes, whole
from basketry.sources.tables import save_table, scratch_root

MIN_TILE = 5
COVERAGE = 0.8
# Scripts that put no spaces between words. Their characters are words of their own.
_UNSEGMENTED = (
    "฀-໿"  # Thai, Lao
    "က-႟"  # Myanmar
    "ក-៿"  # Khmer
    "぀-ヿㇰ-ㇿ"  # Hiragana, Katakana
    "㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff"  # Han
)
_TOKEN = re.compile(rf"(?=\w)[{_UNSEGMENTED}]|[^\W{_UNSEGMENTED}]+")


def tokens(text: str) -> list[str]:
    """Runs of letters, digits and underscores, in lower case; single characters of scripts without spaces."""
    return _TOKEN.findall(text.lower())


def _numbered(text: list[str], item: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Both as numbers of the item's words; words that the item lacks are -1."""
    numbers = {word: i for i, word in enumerate(dict.fromkeys(item))}
    return (np.fromiter((numbers.get(w, -1) for w in words), dtype=np.int64, count=len(words)) for words in (text, item))


def _common_runs(text: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(length, item start, text start) of the runs of ``least`` words or more that no further word prolongs."""
    item_seeds, text_seeds = (shingle_hashes(mixed(words.astype(np.uint64)), least) for words in (item, text))
    order = np.argsort(item_seeds, kind="stable")
    low, high = (np.searchsorted(item_seeds[order], text_seeds, side=side) for side in ("left", "right"))
    counts = high - low
    at = np.repeat(np.arange(len(text_seeds)), counts)
    start = order[np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts - low, counts)]
    # Equal hashes are compared word by word.
    same = np.ones(len(at), dtype=bool)
    for k in range(least):
        same &= text[at + k] == item[start + k]
    at, start = at[same], start[same]
    by = np.lexsort((start, at - start))
    at, start = at[by], start[by]
    heads = np.flatnonzero(np.concatenate([[True], (np.diff(at - start) != 0) | (np.diff(start) != 1)])) if len(at) else at
    sizes = np.diff(np.concatenate([heads, [len(at)]])) + least - 1
    return list(zip(sizes.tolist(), start[heads].tolist(), at[heads].tolist(), strict=True))


def tile(text: list[str], item: list[str], least: int = MIN_TILE) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (length, item start, text start) of tiles that overlap neither in item nor in text.

    The longest run of free words goes first, ties by item start and then text start, until none has ``least`` words.
    A run that is partly covered when its turn comes leaves its free parts to the queue, so every tile is the longest
    there is.
    """
    if min(len(text), len(item)) < least:
        return []
    text_words, item_words = _numbered(text, item)
    queue = [(-size, start, place) for size, start, place in _common_runs(text_words, item_words, least)]
    heapq.heapify(queue)
    text_free, item_free = np.ones(len(text), dtype=bool), np.ones(len(item), dtype=bool)
    tiles = []
    while queue:
        size, start, place = heapq.heappop(queue)
        size = -size
        free = item_free[start : start + size] & text_free[place : place + size]
        if free.all():
            item_free[start : start + size] = text_free[place : place + size] = False
            tiles.append((size, start, place))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[False], free, [False]])))
        for low, high in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if high - low >= least:
                heapq.heappush(queue, (low - high, start + low, place + low))
    return tiles


def _seeds(hashes: WordHashes, words: list[str], length: int) -> np.ndarray:
    """Keys of all runs of ``length`` words; runs of different lengths have different keys."""
    return mixed(shingle_hashes(hashes.of(words), length) + np.uint64(length))


def _item_rows(least: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            words = [tokens(t) for t in batch.column("text").to_pylist()]
            own = [min(least, len(w)) for w in words]
            seeds = [_seeds(hashes, w, n).view(np.int64).tolist() if n else [] for w, n in zip(words, own, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("item_key"), batch.column("item_id"), pa.array([" ".join(w) for w in words], pa.string()), pa.array([len(w) for w in words], pa.int32()), pa.array(own, pa.int32()), pa.array(seeds, pa.list_(pa.int64()))],
                names=["item_key", "item_id", "item_words", "n_words", "least", "seeds"],
            )

    return rows


def _stretches(lengths: list[int], shared):
    """Of each text, by length of the seeds: the stretches of words in which every run of that length may be a seed."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, table = WordHashes(), shared.value
        for batch in batches:
            owners, leasts, starts, words_of, seeds_of = [], [], [], [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                words = tokens(text)
                for least in lengths:
                    seeds = _seeds(hashes, words, least)
                    at = np.flatnonzero(in_filter(table, seeds))
                    for run in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1) if len(at) else ():
                        owners.append(row)
                        leasts.append(least)
                        starts.append(int(run[0]))
                        words_of.append(" ".join(words[run[0] : run[-1] + least]))
                        seeds_of.append(seeds[run[0] : run[-1] + 1].view(np.int64).tolist())
                hashes.trim()
            chosen = batch.select(["doc_key", "doc_id"]).take(pa.array(owners, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*chosen.columns, pa.array(leasts, pa.int32()), pa.array(starts, pa.int32()), pa.array(words_of, pa.string()), pa.array(seeds_of, pa.list_(pa.int64()))],
                names=["doc_key", "doc_id", "least", "start", "words", "seeds"],
            )

    return rows


def rarest_seeds(documents: list[int], least: int, spared: int) -> list[int]:
    """Places of seeds of which every tiling has one that leaves at most ``spared`` words of the test uncovered.

    ``documents``: in how many documents each seed stands. Of any ``spared`` + 1 words one is covered, by a tile that has
    a seed around it. The words whose seeds stand in the fewest documents are taken.
    """
    n = len(documents) + least - 1
    counts = np.array(documents, dtype=np.int64)
    sums = np.concatenate([[0], np.cumsum(counts)])
    word = np.arange(n)
    first, last = np.maximum(word - least + 1, 0), np.minimum(word, len(counts) - 1)
    cost = sums[last + 1] - sums[first]
    chosen = np.argsort(cost, kind="stable")[: spared + 1]
    places = {p for w in chosen.tolist() for p in range(first[w], last[w] + 1) if documents[p]}
    return sorted(places)


def _choices(coverage: float):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, seeds_of = [], []
            names = ("item_key", "n_words", "least", "seeds", "known")
            for key, n, least, seeds, known in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                counts = {k["seed"]: k["documents"] for k in known}
                spared = n - int(np.ceil(n * coverage - 1e-9))
                chosen = rarest_seeds([counts.get(s, 0) for s in seeds], least, spared)
                found = {seeds[p] for p in chosen}
                keys += [key] * len(found)
                seeds_of += sorted(found)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(seeds_of, pa.int64())], names=["item_key", "seed"])

    return rows


def _tilings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        covered, counts = [], []
        names = ("stretches", "item_words", "least")
        for stretches, item, least in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            text: list[str] = []
            for stretch in sorted(stretches, key=lambda s: s["start"]):
                text += [*stretch["words"].split(" "), ""]  # no word is empty, so no tile crosses a gap
            tiles = tile(text, item.split(" "), least)
            covered.append(sum(size for size, _, _ in tiles))
            counts.append(len(tiles))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_key"), batch.column("item_id"), batch.column("n_words"), pa.array(covered, pa.int32()), pa.array(counts, pa.int32())],
            names=["doc_key", "item_id", "n_words", "n_covered", "n_tiles"],
        )


def _doc_key(text_col: str):
    """Documents go by the SHA-256 of their text: copies are compared once."""
    return F.sha2(whole(text_col).cast("binary"), 256)


def contaminated(
    docs: DataFrame,
    tests: DataFrame,
    coverage: float = COVERAGE,
    least: int = MIN_TILE,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """Documents and the tests they hold: ``doc_id``, ``item_id``, ``n_words``, ``n_covered``, ``n_tiles``, ``coverage``, ``doc_key``.

    A row for each pair of a document and a test of which tiles of ``least`` words or more cover the share
    ``coverage``. A test of fewer than ``least`` words is found where all its words stand in a row; one without words
    (null texts are empty) is never found. Tests with one text are all reported; null ids are kept; repeated rows of a
    document or of a test count once. Empty tables give an empty result, other columns are not read.

    Documents are read once, whole, and filtered by a bitmap of fixed size; what passes is joined with the seeds.
    """
    spark = docs.sparkSession
    root = scratch_root(spark)
    kinds = {"item": tests.schema[item_col].dataType.simpleString(), "doc": docs.schema[id_col].dataType.simpleString()}
    items = tests.select(F.col(item_col).alias("item_id"), whole(item_text_col).alias("text"))
    items = items.distinct().withColumn("item_key", F.xxhash64("item_id", "text")).mapInArrow(
        _item_rows(least), f"item_key bigint, item_id {kinds['item']}, item_words string, n_words int, least int, seeds array<bigint>"
    )
    items = save_table(items.where("n_words > 0"), root, "tests")
    lengths = sorted(r.least for r in items.select("least").distinct().collect())  # at most ``least`` of them
    item_seeds = items.select(F.explode("seeds").alias("seed"))
    shared = spark.sparkContext.broadcast(set_filter(item_seeds, "seed"))
    rows = docs.select(_doc_key(text_col).alias("doc_key"), F.col(id_col).alias("doc_id"), whole(text_col).alias("text"))
    stretches = rows.mapInArrow(
        _stretches(lengths, shared), f"doc_key string, doc_id {kinds['doc']}, least int, start int, words string, seeds array<bigint>"
    )
    stretches = save_table(stretches, root, "stretches")
    # Copies of a text have one key and equal stretches.
    seeds = stretches.select("doc_key", F.explode("seeds").alias("seed")).distinct()
    documents = seeds.groupBy("seed").agg(F.count(F.lit(1)).alias("documents"))
    # Of a test there are at most as many seeds as words.
    known = items.select("item_key", F.explode(F.array_distinct("seeds")).alias("seed")).join(documents, "seed")
    known = known.groupBy("item_key").agg(F.collect_list(F.struct("seed", "documents")).alias("known"))
    chosen = items.select("item_key", "n_words", "least", "seeds").join(known, "item_key").mapInArrow(_choices(coverage), "item_key bigint, seed bigint")
    chosen = save_table(chosen, root, "chosen")
    pairs = seeds.join(chosen, "seed").select("doc_key", "item_key").distinct()
    texts = stretches.groupBy("doc_key", "least").agg(F.collect_set(F.struct("start", "words")).alias("stretches"))
    found = (
        pairs.join(items.drop("seeds"), "item_key")
        .join(texts, ["doc_key", "least"])
        .select("doc_key", "item_id", "item_words", "n_words", "least", "stretches")
        .mapInArrow(_tilings, f"doc_key string, item_id {kinds['item']}, n_words int, n_covered int, n_tiles int")
        .where(F.col("n_covered") >= F.ceil(F.col("n_words") * coverage - 1e-9))
    )
    owners = stretches.select("doc_key", "doc_id").distinct()
    return owners.join(found, "doc_key").select(
        "doc_id", "item_id", "n_words", "n_covered", "n_tiles", (F.col("n_covered") / F.col("n_words")).alias("coverage"), "doc_key"
    )


def drop_contaminated(docs: DataFrame, tests: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that hold no test, with all their columns, whatever the names of these.

    Tests are found as by :func:`contaminated`, with its rules for nulls and empty texts. A document goes by its text, so
    rows that repeat a found text go, under whatever id; another text under the same id, or a null one, stays. An empty
    table gives an empty result, without tests everything stays.
    """
    found = contaminated(docs, tests, id_col=id_col, text_col=text_col, **options)
    (key,) = fresh_names(docs, 1)
    found = found.select(F.col("doc_key").alias(key)).distinct()
    return docs.join(found, _doc_key(text_col) == F.col(key), "left_anti")
