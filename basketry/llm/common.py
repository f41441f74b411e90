"""What several operators share: opening tables, word rules, a set filter of fixed size, connected components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count as itertools_count, islice

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from basketry.sources.tables import save_table

# White space of the word rules: space and the characters 9 to 13.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
LOWER_ASCII = {c: c + 32 for c in range(65, 91)}


def open_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def whole(text: str) -> Column:
    """The text of a column; null counts as empty."""
    return F.coalesce(F.col(text), F.lit(""))


def fresh_names(frame: DataFrame, count: int) -> list[str]:
    """Column names that ``frame`` does not have, in any spelling."""
    taken = {c.lower() for c in frame.columns}
    return list(islice((name for n in itertools_count() if (name := f"__own{n}") not in taken), count))


def fold_ascii(text: str) -> str:
    """A-Z in lower case, every other character as it is."""
    return text.translate(LOWER_ASCII)


def rows_of(batches: Iterator, *names: str) -> Iterator[tuple]:
    """The named columns of Arrow batches, row by row, as Python values."""
    for batch in batches:
        yield from zip(*(batch.column(n).to_pylist() for n in names), strict=True)


class WordHashes(dict):
    """64-bit hashes of words, remembered; :meth:`trim` between texts bounds the memory."""

    def __missing__(self, word: str) -> int:
        found = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return found

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))

    def trim(self, most: int = 1_000_000) -> None:
        if len(self) > most:
            self.clear()


_ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(keys: np.ndarray) -> np.ndarray:
    """A bijection of uint64 values that spreads every bit over all."""
    keys = (keys ^ (keys >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    keys = (keys ^ (keys >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return keys ^ (keys >> np.uint64(31))


def shingle_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of ``length`` words, in order, from the hashes of the words."""
    if len(words) < length:
        return np.zeros(0, dtype=np.uint64)
    found = np.zeros(len(words) - length + 1, dtype=np.uint64)
    for at in range(length):
        found = found * _ODD + words[at : at + len(found)]
    return mixed(found)


#: Bits of a set filter: 2**26 bits are 8 MB, at any data size.
FILTER_BITS = 26
# Bits that one value of bitmap_construct_agg holds.
BITMAP_BITS = 32768


def set_filter(frame: DataFrame, key: str, bits: int = FILTER_BITS, probes: int = 1) -> np.ndarray:
    """A bitmap over the low ``bits`` bits of the bigint column ``key``, as a byte array of fixed size.

    The result is a filter before a join: every key of ``frame`` passes :func:`in_filter`, few others do. When the
    keys outnumber the bits all pass and the join alone decides, so the size of the filter never depends on the data.
    With two ``probes`` the next ``bits`` bits are marked too; that is of use where keys are hashes.
    """
    mask = F.lit((1 << bits) - 1)
    slots = F.array(*(F.shiftrightunsigned(F.col(key), bits * at).bitwiseAND(mask) for at in range(probes)))
    parts = (
        frame.where(F.col(key).isNotNull())
        .select(F.explode(slots).alias("__slot"))
        .groupBy((F.col("__slot") / BITMAP_BITS).cast("bigint").alias("__part"))
        .agg(F.bitmap_construct_agg((F.col("__slot") % BITMAP_BITS)).alias("__bits"))
    )
    table = np.zeros(max((1 << bits) // 8, BITMAP_BITS // 8), dtype=np.uint8)
    for part, packed in parts.collect():  # at most 2**bits bits, at any data size
        start = part * (BITMAP_BITS // 8)
        table[start : start + len(packed)] = np.frombuffer(packed, dtype=np.uint8)
    return table


def in_filter(table: np.ndarray, keys: np.ndarray, bits: int = FILTER_BITS, probes: int = 1) -> np.ndarray:
    """Which of the int64 or uint64 ``keys`` may be in the set of ``table``."""
    found = np.ones(len(keys), dtype=bool)
    for at in range(probes):
        slots = (keys.astype(np.uint64) >> np.uint64(bits * at)) & np.uint64((1 << bits) - 1)
        found &= (table[(slots >> np.uint64(3)).astype(np.int64)] >> (slots & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return found


def maybe_in(frame: DataFrame, key: str, column: str) -> Column:
    """Whether the bigint ``column`` of another frame may be among the keys of ``frame``; false is certain.

    Only this column passes through Python. A null counts as 0.
    """
    shared = frame.sparkSession.sparkContext.broadcast(set_filter(frame, key))

    @F.pandas_udf("boolean")
    def maybe(keys):
        import pandas as pd

        return pd.Series(in_filter(shared.value, keys.to_numpy(dtype=np.int64)))

    # Not deterministic, so that Spark does not repeat the test on the other side of a join.
    return maybe.asNondeterministic()(F.coalesce(F.col(column), F.lit(0)))


def components(links: DataFrame, root: str, name: str) -> DataFrame:
    """Rows (``node``, ``component``): the smallest node that the ``links`` (``a``, ``b``: bigint) reach from it.

    Alternating large and small star steps: every step moves links towards the smallest neighbour, and the number
    of steps grows with the logarithm of the longest path. Each step is one written table, so that lost executors
    repeat no earlier step. A node's list of neighbours is never collected: minima are window-free aggregates.
    """
    spark = links.sparkSession
    pairs = links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    pairs = save_table(pairs.distinct(), root, f"{name}-0")
    before, step = None, 0
    while True:
        # Large star: neighbours above a node are linked to the smallest node around it.
        both = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        # Small star: a node and its neighbours below it are linked to the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        step += 1
        pairs = save_table(small.union(least.select("a", F.col("m").alias("b"))).distinct(), root, f"{name}-{step}")
        now = pairs.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == before or not now[0]:
            break
        before = now
    nodes = pairs.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return save_table(nodes.union(roots), root, f"{name}-all")
