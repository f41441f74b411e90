"""Near duplicates by an LSH forest over MinHash signatures, each link confirmed on the whole sets.

A forest is several orders of the signatures: each begins at another value and goes round all of them. In an order,
documents that share a prefix of ``DEPTH`` values form a region, which is as deep as a pair at the threshold is sure to
meet in some order. A region of two is a candidate pair. In a larger one that depth is too small to tell, so its
documents are sorted by the rest of the order, and it is divided where neighbours have the shortest common prefixes,
until its parts are small: the depth of a part is the longest prefix that its neighbours share, more where the region
is crowded. Each part yields the most similar pairs that connect it (a maximum spanning forest), never all pairs. When those are
confirmed and connected, only components that meet in a region and are still apart are left. Those that look alike
make a family, in which the documents outside the main component are compared with all others, on whole sets, block
by block. So no pair that shares a region is lost, a group of n copies costs in the order of n comparisons, and no
list of pairs grows with the square of a group.

Signatures decide only what is compared; a pair whose 128 signature bytes agree in less than ``SURELY_LESS`` is not
(five standard deviations below the threshold). Two sets with the similarity 0.8 share no region of 40 orders in one
case in eight million.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from basketry.llm.common import WordHashes, components, fresh_names, maybe_in, mixed, shingle_hashes, whole
from basketry.sources.tables import save_table, scratch_root

SHINGLE = 5
THRESHOLD = 0.8
TREES = 40
DEPTH = 5
SIGNATURE = 128
SURELY_LESS = 0.62
#: Documents that are compared in memory at once.
BLOCK = 256

_MULTIPLIERS = np.random.default_rng(20).integers(1, 1 << 63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(words: list[bytes], length: int, hashes: WordHashes) -> np.ndarray:
    """The sorted distinct 64-bit hashes of all runs of ``length`` words; of a shorter text, that of the whole."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(words) < length:
        return shingle_hashes(hashes.of(words), len(words)) ^ np.uint64(len(words))
    return np.unique(shingle_hashes(hashes.of(words), length))


class _ByteHashes(WordHashes):
    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


def _words(text: str) -> list[bytes]:
    """Words between space and the characters 9 to 13, A-Z in lower case, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def _signature(shingles: np.ndarray) -> np.ndarray:
    least = np.full(len(_MULTIPLIERS), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), 512):
        np.minimum(least, (shingles[at : at + 512, None] * _MULTIPLIERS).min(0), out=least)
    return least


def _sets(length: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _ByteHashes()
        trees = np.arange(TREES, dtype=np.uint64)
        for batch in batches:
            sizes, keys, signatures, prefixes = [], [], [], []
            for text in batch.column("text").to_pylist():
                shingles = shingle_set(_words(text), length, hashes)
                hashes.trim()
                sizes.append(len(shingles))
                keys.append(xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None)
                least = _signature(shingles)
                signatures.append((least[:SIGNATURE] & np.uint64(255)).astype(np.uint8).tobytes())
                prefix = trees
                for value in least.reshape(TREES, DEPTH).T:
                    prefix = mixed(prefix ^ value)
                prefixes.append(prefix.view(np.int64))
            flat = pa.array(np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64))
            offsets = pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * TREES)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(signatures, pa.binary()), pa.ListArray.from_arrays(offsets, flat)],
                names=["doc_id", "n", "set_key", "signature", "prefixes"],
            )

    return rows


def common_prefixes(signatures: np.ndarray) -> np.ndarray:
    """How many leading values each row of a sorted region shares with the row before it."""
    equal = signatures[1:] == signatures[:-1]
    return np.where(equal.all(1), signatures.shape[1], equal.argmin(1))


def shallowest(columns: dict[str, np.ndarray], low: int) -> int:
    """Rows from ``low`` on that go before the shortest common prefix among the places where a part may end."""
    prefixes = common_prefixes(columns["signature"][low + BLOCK // 2 - 1 : low + 2 * BLOCK])
    return BLOCK // 2 + int(prefixes.argmin())


def _groups(batches: Iterator[pa.RecordBatch], by: str, cut=lambda columns, low: BLOCK) -> Iterator[dict[str, np.ndarray]]:
    """Consecutive rows with one value of ``by``, across batches; of a group beyond ``2 * BLOCK``, parts as ``cut`` tells."""
    rest: dict[str, np.ndarray] = {}
    for batch in batches:
        columns = {}
        for name in batch.schema.names:
            if name == "signature":
                flat = np.frombuffer(b"".join(batch.column(name).to_pylist()), dtype=np.uint8)
                columns[name] = flat.reshape(-1, SIGNATURE)
            elif name == "text":
                columns[name] = np.array(batch.column(name).to_pylist(), dtype=object)
            else:
                columns[name] = batch.column(name).to_numpy(zero_copy_only=False)
        if rest:
            columns = {n: np.concatenate([rest[n], v]) for n, v in columns.items()}
        key = columns[by]
        edges = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        for low, high in zip(edges[:-2], edges[1:-1], strict=True):
            yield {n: v[low:high] for n, v in columns.items()}
        low = edges[-2]
        while len(key) - low > 2 * BLOCK:
            size = cut(columns, low)
            yield {n: v[low : low + size] for n, v in columns.items()}
            low += size
        rest = {n: v[low:] for n, v in columns.items()}
    if rest and len(rest[by]):
        yield rest


def _alike(signature: np.ndarray, n: np.ndarray, i: int, others: slice | np.ndarray, ratio: float) -> np.ndarray:
    """Shares of equal signature bytes of row ``i`` and ``others``, -1 where the sizes exclude the threshold."""
    share = (signature[others] == signature[i]).mean(1)
    small, large = np.minimum(n[others], n[i]), np.maximum(n[others], n[i])
    return np.where(small >= ratio * large - 1e-9, share, -1)


def _forest(ratio: float, surely_less: float):
    """Of each part of a sorted region: the most similar pairs that connect it."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, "prefix", shallowest):
            ids, sizes, bytes_ = group["node"], group["n"], group["signature"]
            found = []
            for i in range(len(ids) - 1):
                share = _alike(bytes_, sizes, i, slice(i + 1, None), ratio)
                found += [(-share[j], i, i + 1 + j) for j in np.flatnonzero(share >= surely_less)]
            found_roots, pairs = _Roots(), []
            for _, i, j in sorted(found):
                if found_roots.join(i, j):
                    pairs.append((max(int(ids[i]), int(ids[j])), min(int(ids[i]), int(ids[j]))))
            if pairs:
                yield _pairs(pairs)

    return rows


def _apart(ratio: float, surely_less: float):
    """Of each cell of a region: pairs of components with documents that look alike, as few as connect them."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _cells(batches):
            component, found = group["component"], _Roots()
            pairs = []
            for i in np.flatnonzero(group["outside"]):
                others = np.flatnonzero(component != component[i])
                share = _alike(group["signature"], group["n"], i, others, ratio)
                for other in np.unique(component[others[share >= surely_less]]).tolist():
                    if found.join(int(component[i]), other):
                        pairs.append((max(int(component[i]), other), min(int(component[i]), other)))
            if pairs:
                yield _pairs(pairs)

    return rows


def _linked(length: int, threshold: float, surely_less: float):
    """Of each cell of a family: links between components, confirmed on the whole sets, as few as connect them."""
    top, bottom = round(threshold * 10_000), 10_000

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _ByteHashes()
        for group in _cells(batches):
            component, node, found = group["component"], group["node"], _Roots()
            sets: dict[int, np.ndarray] = {}

            def shingles(row: int) -> np.ndarray:
                if row not in sets:
                    sets[row] = shingle_set(_words(group["text"][row]), length, hashes)
                    hashes.trim()
                return sets[row]

            pairs = []
            for i in np.flatnonzero(group["outside"]).tolist():
                others = np.flatnonzero(component != component[i])
                share = _alike(group["signature"], group["n"], i, others, threshold)
                for at in np.argsort(-share, kind="stable"):
                    j = int(others[at])
                    if share[at] < surely_less:
                        break
                    if found.joined(int(component[i]), int(component[j])):
                        continue
                    one, two = shingles(i), shingles(j)
                    common = len(np.intersect1d(one, two, assume_unique=True))
                    if common and bottom * common >= top * (len(one) + len(two) - common):
                        found.join(int(component[i]), int(component[j]))
                        pairs.append((max(int(node[i]), int(node[j])), min(int(node[i]), int(node[j]))))
            if pairs:
                yield _pairs(pairs)

    return rows


class _Roots(dict):
    """Which keys are connected."""

    def find(self, x: int) -> int:
        while (up := self.setdefault(x, x)) != x:
            self[x] = x = self.setdefault(up, up)
        return x

    def joined(self, x: int, y: int) -> bool:
        return self.find(x) == self.find(y)

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self[x] = y
        return x != y


def _pairs(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*pairs, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """Whole cells, which hold about two blocks each."""
    pieces: list[dict[str, np.ndarray]] = []
    for group in _groups(batches, "cell"):
        if pieces and pieces[-1]["cell"][0] != group["cell"][0]:
            yield {n: np.concatenate([p[n] for p in pieces]) for n in group}
            pieces = []
        pieces.append(group)
    if pieces:
        yield {n: np.concatenate([p[n] for p in pieces]) for n in pieces[0]}


def _similar(length: int, threshold: float):
    """Confirm pairs on their whole sets."""
    top, bottom = round(threshold * 10_000), 10_000

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _ByteHashes()
        for batch in batches:
            linked, last, first = [], None, None
            for text_a, text_b in zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist(), strict=True):
                if text_a != last:
                    last, first = text_a, shingle_set(_words(text_a), length, hashes)
                second = shingle_set(_words(text_b), length, hashes)
                hashes.trim()
                common = len(np.intersect1d(first, second, assume_unique=True))
                linked.append(common > 0 and bottom * common >= top * (len(first) + len(second) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    return rows


def _confirm(pairs: DataFrame, texts: DataFrame, length: int, threshold: float, root: str, name: str) -> DataFrame:
    """``pairs`` (``a``, ``b``) that link, as a written table. ``texts``: doc_id, text of all documents."""
    pairs = save_table(pairs.distinct(), root, f"{name}-pairs")
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    # Documents that surely have no pair are not shuffled.
    some = texts.where(maybe_in(nodes, "node", "doc_id")).join(nodes, F.col("doc_id") == F.col("node"), "left_semi")
    some = save_table(some, root, f"{name}-texts")
    both = pairs.join(some.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    both = both.join(some.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")
    found = both.mapInArrow(_similar(length, threshold), "a bigint, b bigint, linked boolean")
    return save_table(found.where("linked").select("a", "b"), root, f"{name}-links")


def near_duplicates(
    docs: DataFrame,
    shingle: int = SHINGLE,
    threshold: float = THRESHOLD,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_shingles``, ``component_id``, ``kept``.

    Two documents link when their sets of ``shingle``-word runs have a Jaccard similarity of ``threshold`` or more.
    A shorter text is one run; a null or empty text, or one of white space, has an empty set and links with
    nothing. ``component_id`` is the smallest id that links reach. Ids are bigint; rows that repeat an id are one
    document, with the links of all their texts. A null id links with nothing: its component is null, it is kept.
    An empty table gives an empty result; other columns are not read.
    """
    root = scratch_root(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), whole(text_col).alias("text"))
    sets = texts.mapInArrow(
        _sets(shingle), "doc_id bigint, n bigint, set_key binary, signature binary, prefixes array<bigint>"
    )
    sets = save_table(sets, root, "sets")
    filled = sets.where(F.col("set_key").isNotNull() & F.col("doc_id").isNotNull())
    # Documents with one set are one node, named by the smallest id.
    nodes = filled.groupBy("set_key").agg(
        F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("signature").alias("signature"), F.first("prefixes").alias("prefixes")
    )
    nodes = save_table(nodes, root, "nodes")
    members = nodes.select("node", F.posexplode("prefixes").alias("tree", "prefix"))
    regions = members.groupBy("prefix").agg(F.count(F.lit(1)).alias("m"), F.min("node").alias("b"), F.max("node").alias("a"))
    regions = save_table(regions.where(F.col("m") > 1), root, "regions")
    twos = regions.where((F.col("m") == 2) & (F.col("a") != F.col("b"))).select("a", "b").distinct()
    one, two = (nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("signature").alias(f"s_{x}")) for x in "ab")
    twos = twos.join(one, "a").join(two, "b").where(
        F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * threshold - 1e-9
    )
    twos = twos.mapInArrow(_pair_filter(SURELY_LESS), "a bigint, b bigint")

    crowds = members.join(regions.where(F.col("m") > 2).select("prefix", "m"), "prefix")
    # Each order goes on from its own values, round the whole signature. What agrees in two signatures still does.
    begin = F.col("tree") * DEPTH % SIGNATURE
    turned = F.concat(F.substring(F.col("signature"), begin + 1, F.lit(SIGNATURE)), F.substring(F.col("signature"), F.lit(1), begin))
    crowds = crowds.join(nodes.select("node", "n", "signature"), "node").select("prefix", "m", "node", "n", turned.alias("signature"))
    crowds = save_table(crowds, root, "crowds")
    spread = crowds.select("prefix", "node", "n", "signature").repartitionByRange("prefix", "signature", "node")
    first = spread.sortWithinPartitions("prefix", "signature", "node").mapInArrow(_forest(threshold, SURELY_LESS), "a bigint, b bigint")
    links = _confirm(twos.union(first.select("a", "b")), texts, shingle, threshold, root, "first")
    found = components(links, root, "first-components")

    placed = crowds.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    alike = _in_cells(placed, ["prefix"]).mapInArrow(_apart(threshold, SURELY_LESS), "a bigint, b bigint")
    families = components(alike.select("a", "b"), root, "families")
    families = families.select(F.col("node").alias("component"), F.col("component").alias("family"))
    kin = nodes.select("node", "n", "signature").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    kin = save_table(kin.join(families, "component"), root, "kin")
    near = texts.where(maybe_in(kin, "node", "doc_id")).join(kin, F.col("doc_id") == F.col("node")).drop("doc_id")
    cells = _in_cells(save_table(near, root, "kin-texts"), ["family"], "text")
    more = cells.mapInArrow(_linked(shingle, threshold, SURELY_LESS), "a bigint, b bigint")
    more = save_table(more, root, "second-links")
    found = components(links.union(more), root, "components")

    named = nodes.select("set_key", "node").join(found, "node", "left")
    named = named.select(F.col("set_key").alias("of"), F.coalesce("component", "node").alias("component"))
    joined = sets.select("doc_id", "n", "set_key").join(named, (F.col("set_key") == F.col("of")) & F.col("doc_id").isNotNull(), "left")
    component = F.coalesce("component", "doc_id")
    return joined.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), component).alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def _pair_filter(surely_less: float):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8).reshape(-1, SIGNATURE) for c in ("s_a", "s_b")
            )
            yield batch.select(["a", "b"]).filter(pa.array((one == two).mean(1) >= surely_less))

    return rows


def _in_cells(placed: DataFrame, group: list[str], *more: str) -> DataFrame:
    """The documents of each group (``node``, ``component`` and others) dealt over cells of about two blocks.

    A cell (i, j) holds block i of the documents outside the group's largest component, marked ``outside``, and
    block j of all documents of the group. Groups of one component are left out.
    """
    sizes = placed.groupBy(*group, "component").agg(F.count(F.lit(1)).alias("rows"))
    apart = sizes.groupBy(*group).agg(
        F.count(F.lit(1)).alias("kinds"), F.sum("rows").alias("all"), F.max("rows").alias("most"),
        F.max_by("component", F.struct("rows", "component")).alias("main"),
    )
    rows = (
        placed.join(apart.where(F.col("kinds") > 1), group)
        .withColumn("outside", F.col("component") != F.col("main"))
        .withColumn("few", F.ceil((F.col("all") - F.col("most")) / BLOCK))
        .withColumn("many", F.ceil(F.col("all") / BLOCK))
    )
    spot, zero = F.xxhash64("node"), F.lit(0).cast("bigint")
    columns = ["node", "n", "signature", "component", *more]
    as_one = rows.where("outside").select(
        *group, F.pmod(spot, "few").alias("i"), F.explode(F.sequence(zero, F.col("many") - 1)).alias("j"), *columns, "outside"
    )
    as_other = rows.select(
        *group, F.explode(F.sequence(zero, F.col("few") - 1)).alias("i"), F.pmod(spot, "many").alias("j"), *columns, F.lit(False).alias("outside")
    )
    cells = as_one.union(as_other).select(F.xxhash64(*group, "i", "j").alias("cell"), *columns, "outside")
    return cells.repartition(F.col("cell")).sortWithinPartitions("cell")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component, with all their columns, whatever their names.

    Components are those of :func:`near_duplicates`, with its rules for empty texts and repeated ids. Rows with a null id
    or an empty text stay. An empty table gives an empty result.
    """
    (name,) = fresh_names(docs, 1)
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, **options)
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col(id_col).cast("bigint") == F.col(name), "left_anti")
