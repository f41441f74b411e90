"""Phrase collocation mining by weighted acyclic automata.

1. Words are counted under their hashes, then pairs of neighbours that are both frequent. The hashes that reach the
   floor become bitmaps of bounded size; an n-gram that is frequent passes them, few others do.
2. Each shard of the texts sorts its n-grams that pass and builds a count transducer of them: an acyclic automaton whose
   arcs are words with counts, in which states with equal continuations are one state.
3. The sorted order of all n-grams is cut into ranges of about equal size. The shards' automata are divided at the cuts,
   meet by prefix range, and are united, the weights summed. What does not reach the floor is dropped.
4. The parts of each range's candidates are a transducer from words to part numbers. Divided at the same cuts, it is
   composed with the count transducers of the parts' ranges; the counts go back to the candidates, which are scored in
   exact integers.
"""

from __future__ import annotations

import pickle
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from basketry.llm.common import in_filter, mixed, set_filter, whole
from basketry.sources.tables import save_table, scratch_root

LONGEST = 3
MIN_COUNT = 10
#: A candidate inside a longer one goes if 100 times the longer one's count is at least so many times its own.
COVER_PERCENT = 50
SCALE = 1_000_000
UNKNOWN_LANGUAGE = "und"
#: Words of a shard, and n-grams of a range, about.
SHARD_WORDS = 2_000_000
RANGE_NGRAMS = 300_000
#: Places in the sorted order that the driver chooses the cuts from, at any data size. Cuts change no result.
SAMPLES = 200_000
_SAMPLE_EVERY = 2048
#: Bits of a filter at most: 128 MB. More frequent n-grams than that lets through are counted, not lost.
MOST_BITS = 30
# Keys of a bucket of the first counts, about, and the most buckets, as a power of two.
_BUCKET, _MOST_BUCKETS = 200_000, 20
_TEXT_CHARS = 4_000_000
_ODD = np.uint64(0x9E3779B97F4A7C15)

# Fixed values of the word rules: A-Z are lower-cased, these characters end a piece, space and tab a word.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
_MARK = b"\xff"  # no byte of UTF-8
_PLAIN = bytes.maketrans(bytes(range(65, 91)) + PIECE_ENDS, bytes(range(97, 123)) + _MARK * len(PIECE_ENDS))


def word_blocks(text: str) -> Iterator[list[bytes]]:
    """The words of a text in order, with a mark between pieces; long texts in several blocks, cut between words."""
    data = text.encode("utf-8", "surrogatepass").translate(_PLAIN)
    low = 0
    while low < len(data):
        high = data.find(b" ", low + _TEXT_CHARS)
        high = len(data) if high < 0 else high
        yield data[low:high].replace(_MARK, b" " + _MARK + b" ").split()
        low = high


class _Numbers(dict):
    """Words numbered as they come; the mark is 0."""

    def __init__(self) -> None:
        super().__init__({_MARK: 0})

    def __missing__(self, word: bytes) -> int:
        found = self[word] = len(self)
        return found


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all runs of ``sizes`` that begin at ``starts``."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes - starts, sizes)


def _shared(offsets: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """States with equal arcs: the new number of each state, and an old state for each new one."""
    sizes, n = np.diff(offsets), len(offsets) - 1
    hashes = np.arange(len(columns[0])).astype(np.uint64) - np.repeat(offsets[:-1], sizes).astype(np.uint64)
    for column in columns:
        hashes = mixed(hashes * _ODD + column.astype(np.uint64))
    digest = np.zeros(n, dtype=np.uint64)
    if len(hashes):
        digest[sizes > 0] = np.add.reduceat(hashes, offsets[:-1][sizes > 0])
    order = np.lexsort((digest, sizes))
    a, b = order[1:], order[:-1]
    same = np.zeros(n, dtype=bool)
    near = np.flatnonzero((sizes[a] == sizes[b]) & (digest[a] == digest[b]))
    # Equal hashes are compared arc by arc.
    left, right = (_spans(offsets[x[near]], sizes[a[near]]) for x in (a, b))
    unequal = np.zeros(len(left), dtype=bool)
    for column in columns:
        unequal |= column[left] != column[right]
    wrong = np.bincount(np.repeat(np.arange(len(near)), sizes[a[near]])[unequal], minlength=len(near)) > 0
    same[near + 1] = ~wrong
    state = np.empty(n, dtype=np.int64)
    state[order] = np.cumsum(~same) - 1
    return state, order[~same]


class CountTransducer:
    """Counts of word sequences of at most ``LONGEST`` words, as an acyclic automaton.

    ``labels`` are the words in byte order. ``tables[d]`` holds the arcs from states after ``d`` words: offsets of the
    states, then label, weight and target of each arc, by state and label. A weight is the count of the sequence that
    the arc ends, 0 if it has none; target -1 has no continuation.
    """

    def __init__(self, labels: list[bytes], tables: list[tuple[np.ndarray, ...]]) -> None:
        self.labels, self.tables = labels, tables

    @staticmethod
    def base(labels: list[bytes]) -> int:
        return len(labels) + 1

    @staticmethod
    def packed(columns: list[np.ndarray], base: int) -> np.ndarray:
        """Sequences as one number each, in the order of the sequences. ``columns``: numbers of labels from 1, 0 for none."""
        kind = np.int64 if base**LONGEST < 1 << 63 else object
        keys = np.zeros(len(columns[0]), dtype=kind)
        for at in range(LONGEST):
            keys = keys * base + (columns[at].astype(kind) if at < len(columns) else 0)
        return keys

    @staticmethod
    def columns(keys: np.ndarray, base: int) -> list[np.ndarray]:
        return [(keys // base ** (LONGEST - 1 - at) % base).astype(np.int64) for at in range(LONGEST)]

    @classmethod
    def build(cls, labels: list[bytes], keys: np.ndarray, weights: np.ndarray) -> CountTransducer:
        """From packed sequences in ascending order, each once. Finished states are registered from the ends on."""
        base = cls.base(labels)
        prefixes, tables = np.zeros(1, dtype=keys.dtype), []
        for depth in range(LONGEST):
            scale = base ** (LONGEST - 1 - depth)
            upto = keys // scale
            upto = upto[upto % base != 0]
            arcs = upto[np.concatenate([[True], upto[1:] != upto[:-1]])] if len(upto) else upto
            at = np.minimum(np.searchsorted(keys, arcs * scale), max(len(keys) - 1, 0))
            weight = np.where(keys[at] == arcs * scale, weights[at], 0) if len(arcs) else weights[:0]
            parents = np.searchsorted(prefixes, arcs // base)
            offsets = np.concatenate([[0], np.cumsum(np.bincount(parents, minlength=len(prefixes)))]).astype(np.int64)
            tables.append((offsets, (arcs % base).astype(np.int64) - 1, weight.astype(np.int64)))
            prefixes = arcs
        target = np.full(len(tables[-1][1]), -1, dtype=np.int64)
        done: list[tuple[np.ndarray, ...]] = []
        for depth in range(LONGEST - 1, -1, -1):
            offsets, label, weight = tables[depth]
            if not depth:
                done.insert(0, (offsets, label, weight, target))
                break
            state, leaders = _shared(offsets, [label, weight, target])
            sizes = np.diff(offsets)
            kept = _spans(offsets[leaders], sizes[leaders])
            done.insert(0, (np.concatenate([[0], np.cumsum(sizes[leaders])]).astype(np.int64), label[kept], weight[kept], target[kept]))
            target = np.where(sizes > 0, state, -1)
        return cls(labels, done)

    def sequences(self) -> tuple[np.ndarray, np.ndarray]:
        """All sequences that have a count, packed and in order, and the counts."""
        base = self.base(self.labels)
        kind = np.int64 if base**LONGEST < 1 << 63 else object
        states, prefix = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=kind)
        keys, weights = [], []
        for depth, (offsets, label, weight, target) in enumerate(self.tables):
            sizes = offsets[states + 1] - offsets[states]
            at = _spans(offsets[states], sizes)
            prefix = np.repeat(prefix, sizes) * base + (label[at] + 1).astype(kind)
            counted = weight[at] > 0
            keys.append(prefix[counted] * base ** (LONGEST - 1 - depth))
            weights.append(weight[at][counted])
            goes_on = target[at] >= 0
            states, prefix = target[at][goes_on], prefix[goes_on]
        keys, weights = np.concatenate(keys), np.concatenate(weights)
        order = np.argsort(keys, kind="stable")
        return keys[order], weights[order]

    def part(self, keys: np.ndarray, weights: np.ndarray) -> CountTransducer:
        """The automaton of some of the sequences, with the labels these have."""
        base = self.base(self.labels)
        columns = self.columns(keys, base)
        used = np.unique(np.concatenate(columns))
        used = used[used > 0]
        numbers = np.searchsorted(used, np.arange(base)) + 1
        numbers[0] = 0
        labels = [self.labels[i - 1] for i in used.tolist()]
        return self.build(labels, self.packed([numbers[c] for c in columns], self.base(labels)), weights)

    @classmethod
    def union(cls, machines: list[CountTransducer]) -> CountTransducer:
        """All sequences of all machines, their weights summed."""
        labels = sorted(set().union(*(m.labels for m in machines)))
        number = {label: i for i, label in enumerate(labels, 1)}
        base, keys, weights = cls.base(labels), [], []
        for machine in machines:
            own, counts = machine.sequences()
            numbers = np.array([0, *(number[label] for label in machine.labels)], dtype=np.int64)
            keys.append(cls.packed([numbers[c] for c in cls.columns(own, cls.base(machine.labels))], base))
            weights.append(counts)
        keys, weights = np.concatenate(keys), np.concatenate(weights)
        order = np.argsort(keys, kind="stable")
        keys, weights = keys[order], weights[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
        return cls.build(labels, keys[first], np.add.reduceat(weights, first) if len(keys) else weights)

    def compose(self, outputs: CountTransducer) -> tuple[np.ndarray, np.ndarray]:
        """Both automata read the same words: for each sequence of ``outputs`` that is counted here, its weight there and here."""
        number = {label: i for i, label in enumerate(self.labels)}
        mapped = np.array([number.get(label, -1) for label in outputs.labels], dtype=np.int64)
        base = self.base(self.labels)
        mine = theirs = np.zeros(1, dtype=np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for (offsets, label, weight, target), (own_offsets, own_label, own_weight, own_target) in zip(outputs.tables, self.tables, strict=True):
            sizes = offsets[theirs + 1] - offsets[theirs]
            at, state = _spans(offsets[theirs], sizes), np.repeat(mine, sizes)
            if not len(at) or not len(own_label):
                break
            arcs = np.repeat(np.arange(len(own_offsets) - 1), np.diff(own_offsets)) * base + own_label
            wanted = state * base + mapped[label[at]]
            own = np.minimum(np.searchsorted(arcs, wanted), len(arcs) - 1)
            both = (mapped[label[at]] >= 0) & (arcs[own] == wanted)
            at, own = at[both], own[both]
            told = (weight[at] > 0) & (own_weight[own] > 0)
            found.append((weight[at][told], own_weight[own][told]))
            on = (target[at] >= 0) & (own_target[own] >= 0)
            theirs, mine = target[at][on], own_target[own][on]
        none = np.zeros(0, dtype=np.int64)
        return tuple(np.concatenate([none, *(f[i] for f in found)]) for i in range(2))

    def at_least(self, floor: int) -> CountTransducer:
        keys, weights = self.sequences()
        return self.part(keys[weights >= floor], weights[weights >= floor])

    def dump(self) -> bytes:
        small = [tuple(c.astype(np.min_scalar_type(int(c.max(initial=0))) if c.min(initial=0) >= 0 else np.int32 if c.max(initial=0) < 1 << 31 else np.int64) for c in t) for t in self.tables]
        return pickle.dumps((self.labels, small), protocol=5)

    @classmethod
    def load(cls, data: bytes) -> CountTransducer:
        labels, tables = pickle.loads(data)
        return cls(labels, [tuple(c.astype(np.int64) for c in t) for t in tables])


Shard = tuple[str, list[bytes], np.ndarray]


def _shards(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[Shard]:
    """Language, vocabulary and word numbers of about ``words`` words at a time; 0 stands between pieces."""
    held: dict[str, tuple[_Numbers, list[np.ndarray]]] = {}
    total = 0

    def all_held() -> Iterator[Shard]:
        for lang, (numbers, blocks) in held.items():
            yield lang, list(numbers), np.concatenate(blocks)
        held.clear()

    for batch in batches:
        for at in range(0, batch.num_rows, 100):
            rows = batch.slice(at, 100)
            for lang, text in zip(rows.column("lang").to_pylist(), rows.column("text").to_pylist(), strict=True):
                numbers, blocks = held.setdefault(lang, (_Numbers(), [np.zeros(1, dtype=np.int32)]))
                for found in word_blocks(text):
                    blocks.append(np.fromiter(map(numbers.__getitem__, found), dtype=np.int32, count=len(found)))
                    total += len(found)
                blocks.append(np.zeros(1, dtype=np.int32))
            if total >= words:
                yield from all_held()
                total = 0
    yield from all_held()


def _word_hashes(lang: str, vocabulary: list[bytes]) -> np.ndarray:
    head = lang.encode("utf-8", "surrogatepass") + _MARK
    found = np.fromiter((xxhash.xxh64_intdigest(head + w) for w in vocabulary), dtype=np.uint64, count=len(vocabulary))
    return found


def _pair_hashes(hashes: np.ndarray, numbers: np.ndarray, at: np.ndarray) -> np.ndarray:
    return mixed(hashes[numbers[at]] * _ODD + hashes[numbers[at + 1]])


def _pairs(usual: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Places of two neighbours that are both ``usual``."""
    marks = usual[numbers]
    return np.flatnonzero(marks[:-1] & marks[1:])


class _Filter:
    """The frequent keys as a bitmap of bounded size; ``keys`` are hashes."""

    def __init__(self, keys: DataFrame) -> None:
        self.bits = min(MOST_BITS, max(16, int(16 * keys.count()).bit_length()))
        self.shared = keys.sparkSession.sparkContext.broadcast(set_filter(keys, "key", self.bits, 2))

    def holds(self, hashes: np.ndarray, low: int) -> np.ndarray:
        return in_filter(self.shared.value, mixed(hashes >> np.uint64(low)), self.bits, 2)


def _count_kind(floor: int) -> str:
    return "<u2" if floor < 1 << 16 else "<u4"


def _bucket_counts(low: int, floor: int, words: int, usual: _Filter | None):
    """Keys of a shard's words, or of its pairs of ``usual`` words, with their counts up to ``floor``, by bucket."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, vocabulary, numbers in _shards(batches, words):
            hashes = _word_hashes(lang, vocabulary)
            if usual is None:
                counts = np.bincount(numbers, minlength=len(vocabulary))[1:]
                keys = hashes[1:] >> np.uint64(low)
            else:
                marks = usual.holds(hashes, low)
                marks[0] = False
                keys, counts = np.unique(_pair_hashes(hashes, numbers, _pairs(marks, numbers)) >> np.uint64(low), return_counts=True)
            order = np.argsort(keys)
            keys, counts = keys[order], np.minimum(counts[order], floor).astype(_count_kind(floor))
            buckets, first = np.unique(keys >> np.uint64(32), return_index=True)
            edges = [*first.tolist(), len(keys)]
            small = keys.astype("<u4")
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(buckets.astype(np.int64)),
                    pa.array([small[a:b].tobytes() for a, b in zip(edges, edges[1:])], pa.binary()),
                    pa.array([counts[a:b].tobytes() for a, b in zip(edges, edges[1:])], pa.binary()),
                ],
                names=["bucket", "keys", "counts"],
            )

    return rows


def _frequent(floor: int):
    """Rows by bucket: the keys whose counts reach ``floor``."""

    def ended(bucket: int, parts: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
        keys = np.frombuffer(b"".join(k for k, _ in parts), dtype="<u4")
        counts = np.frombuffer(b"".join(c for _, c in parts), dtype=_count_kind(floor))
        distinct, at = np.unique(keys, return_inverse=True)
        kept = distinct[np.bincount(at, counts) >= floor].astype(np.uint64) | np.uint64(bucket << 32)
        return pa.RecordBatch.from_arrays([pa.array(mixed(kept).view(np.int64))], names=["key"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = -1, []
        for batch in batches:
            for bucket, keys, counts in zip(*(batch.column(c).to_pylist() for c in ("bucket", "keys", "counts")), strict=True):
                if bucket != now and parts:
                    yield ended(now, parts)
                    parts = []
                now = bucket
                parts.append((keys, counts))
        if parts:
            yield ended(now, parts)

    return rows


def _machines(low: int, words: int, usual: _Filter, pairs: _Filter):
    """A count transducer of each shard, of the n-grams that may be frequent, with words of some of them."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, vocabulary, numbers in _shards(batches, words):
            hashes = _word_hashes(lang, vocabulary)
            marks = usual.holds(hashes, low)
            marks[0] = False
            chosen = sorted(np.flatnonzero(marks).tolist(), key=vocabulary.__getitem__)
            labels = [vocabulary[i] for i in chosen]
            rank = np.zeros(len(vocabulary), dtype=np.int64)
            rank[chosen] = np.arange(1, len(chosen) + 1)
            at = _pairs(marks, numbers)
            at = at[pairs.holds(_pair_hashes(hashes, numbers, at), low)]
            triples = at[:-1][at[1:] == at[:-1] + 1]
            counts = np.bincount(numbers, minlength=len(vocabulary))[chosen]
            base, keys, weights = CountTransducer.base(labels), [CountTransducer.packed([np.arange(1, len(labels) + 1)], len(labels) + 1)], [counts]
            for places, length in ((at, 2), (triples, 3)):
                packed, n = np.unique(CountTransducer.packed([rank[numbers[places + i]] for i in range(length)], base), return_counts=True)
                keys.append(packed)
                weights.append(n)
            keys, weights = np.concatenate(keys), np.concatenate(weights)
            order = np.argsort(keys, kind="stable")
            keys, weights = keys[order], weights[order]
            samples = [_words(labels, k, base) for k in keys[_SAMPLE_EVERY // 2 :: _SAMPLE_EVERY].tolist()]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang]),
                    pa.array([int(np.count_nonzero(numbers))], pa.int64()),
                    pa.array([len(keys)], pa.int64()),
                    pa.array([samples], pa.list_(pa.binary())),
                    pa.array([CountTransducer.build(labels, keys, weights).dump()], pa.binary()),
                ],
                names=["lang", "words", "ngrams", "samples", "machine"],
            )

    return rows


def _words(labels: list[bytes], key: int, base: int) -> bytes:
    """The sequence with a space after each word but the last; no word has one."""
    found = []
    for at in range(LONGEST):
        number = key // base ** (LONGEST - 1 - at) % base
        if number:
            found.append(labels[number - 1])
    return b" ".join(found)


Cuts = dict[str, list[tuple[bytes, ...]]]


def _chosen_cuts(samples: list[tuple[str, bytes]], ranges: int) -> Cuts:
    """Where each language's sorted order is cut: about ``ranges`` ranges over all languages."""
    order = sorted({(lang, tuple(s.split(b" "))) for lang, s in samples})
    cuts: Cuts = {}
    for lang, words in dict.fromkeys(order[i * len(order) // ranges] for i in range(1, ranges) if order):
        cuts.setdefault(lang, []).append(words)
    return cuts


def _cut_keys(cuts: list[tuple[bytes, ...]], labels: list[bytes]) -> np.ndarray:
    """For each cut the least packed sequence over ``labels`` that is not before it."""
    base, found = CountTransducer.base(labels), []
    for words in cuts:
        numbers = []
        for word in words:
            at = bisect_left(labels, word)
            numbers.append(at + 1)
            if at == len(labels) or labels[at] != word:
                break
        key = 0
        for at in range(LONGEST):
            key = key * base + (numbers[at] if at < len(numbers) else 0)
        found.append(key)
    return np.array(found, dtype=np.int64 if base**LONGEST < 1 << 62 else object)


def _by_cuts(cuts: Cuts, lang: str, labels: list[bytes], keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(range of the language, first, end) of the ascending ``keys``."""
    edges = [0, *np.searchsorted(keys, _cut_keys(cuts.get(lang, []), labels)).tolist(), len(keys)]
    for i, (low, high) in enumerate(zip(edges, edges[1:])):
        if low < high:
            yield i, low, high


def _divided(cuts):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, data in zip(batch.column("lang").to_pylist(), batch.column("machine").to_pylist(), strict=True):
                machine = CountTransducer.load(data)
                keys, weights = machine.sequences()
                for part, low, high in _by_cuts(cuts.value, lang, machine.labels, keys):
                    yield _row(lang=lang, part=part, machine=machine.part(keys[low:high], weights[low:high]).dump())

    return rows


def _row(**values) -> pa.RecordBatch:
    kinds = {str: pa.string(), int: pa.int64(), bytes: pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([v], kinds[type(v)]) for v in values.values()], names=list(values))


def _united(floor: int):
    """Rows by language and range: the union of each range, without what does not reach ``floor``."""

    def ended(key: tuple[str, int], stack: list[tuple[int, CountTransducer]]) -> Iterator[pa.RecordBatch]:
        machine = CountTransducer.union([m for _, m in stack]).at_least(floor)
        if machine.labels:
            yield _row(lang=key[0], part=key[1], machine=machine.dump())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, stack = None, []
        for batch in batches:
            for lang, part, data in zip(*(batch.column(c).to_pylist() for c in ("lang", "part", "machine")), strict=True):
                if now != (lang, part):
                    if now:
                        yield from ended(now, stack)
                    now, stack = (lang, part), []
                stack.append((len(data), CountTransducer.load(data)))
                # Machines of like size unite, so that each sequence is united as often as the logarithm of the shards.
                while len(stack) > 8 and stack[-8][0] <= 8 * stack[-1][0]:
                    last = stack[-8:]
                    stack[-8:] = [(sum(n for n, _ in last), CountTransducer.union([m for _, m in last]))]
        if now:
            yield from ended(now, stack)

    return rows


def _cuttings(columns: list[np.ndarray]) -> list[tuple[list[np.ndarray], list[np.ndarray]]]:
    """The ways to divide sequences of a length: columns of the first part and of the rest."""
    return [(columns[:k], columns[k:]) for k in range(1, len(columns))]


def _candidates(machine: CountTransducer) -> Iterator[tuple[np.ndarray, np.ndarray, list]]:
    """By length: candidates, their counts, and the packed parts of each way to divide them."""
    base = machine.base(machine.labels)
    keys, weights = machine.sequences()
    columns = machine.columns(keys, base)
    lengths = sum((c > 0).astype(np.int64) for c in columns)
    for length in range(2, LONGEST + 1):
        of = np.flatnonzero(lengths == length)
        parts = _cuttings([c[of] for c in columns[:length]])
        yield keys[of], weights[of], [tuple(machine.packed(p, base) for p in pair) for pair in parts]


def _distinct_parts(machine: CountTransducer) -> np.ndarray:
    parts = [p for _, _, ways in _candidates(machine) for pair in ways for p in pair]
    return np.unique(np.concatenate(parts))


def _asked(cuts):
    """The parts of the candidates of each range, as transducers from words to part numbers, by the parts' ranges."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, part, data in zip(*(batch.column(c).to_pylist() for c in ("lang", "part", "machine")), strict=True):
                machine = CountTransducer.load(data)
                parts = _distinct_parts(machine)
                for to, low, high in _by_cuts(cuts.value, lang, machine.labels, parts):
                    asked = machine.part(parts[low:high], np.arange(low + 1, high + 1))
                    yield _row(lang=lang, part=to, back=part, machine=asked.dump())

    return rows


def _composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by language and range, the counts (``back`` -1) first: part numbers and counts for the range that asked."""
    now, counts = None, None
    for batch in batches:
        for lang, part, back, data in zip(*(batch.column(c).to_pylist() for c in ("lang", "part", "back", "machine")), strict=True):
            if back < 0:
                now, counts = (lang, part), CountTransducer.load(data)
            elif now == (lang, part):
                numbers, found = counts.compose(CountTransducer.load(data))
                yield _row(lang=lang, part=back, back=1, machine=np.stack([numbers, found]).astype("<i8").tobytes())


def _scored(scale: int):
    """Rows by language and range, the candidates (``back`` -1) first, then the counts of their parts: the scores."""

    def ended(lang: str, machine: CountTransducer, answers: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        parts = _distinct_parts(machine)
        counts = np.zeros(len(parts), dtype=np.int64)
        for numbers, found in answers:
            counts[numbers - 1] = found
        base = machine.base(machine.labels)
        for keys, weights, ways in _candidates(machine):
            sides = [[counts[np.searchsorted(parts, p)].tolist() for p in pair] for pair in ways]
            phrases = [_words(machine.labels, k, base).decode("utf-8", "surrogatepass") for k in keys.tolist()]
            chosen = []
            for i, a in enumerate(weights.tolist()):
                chosen.append(min((scale * a * a // (left[i] * right[i]), k, left[i], right[i]) for k, (left, right) in enumerate(sides)))
            for low in range(0, len(phrases), 20_000):
                part = slice(low, low + 20_000)
                score, _, left, right = zip(*chosen[part], strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(score)), pa.array(phrases[part]), pa.array([len(ways) + 1] * len(score), pa.int32()), *(pa.array(c, pa.int64()) for c in (weights[part], left, right, score))],
                    names=["lang", "phrase", "length", "a", "l", "r", "score"],
                )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, machine, answers = "", None, []
        for batch in batches:
            for lang, part, back, data in zip(*(batch.column(c).to_pylist() for c in ("lang", "part", "back", "machine")), strict=True):
                if back < 0:
                    if machine is not None:
                        yield from ended(now, machine, answers)
                    now, machine, answers = lang, CountTransducer.load(data), []
                else:
                    answers.append(np.frombuffer(data, dtype="<i8").reshape(2, -1))
        if machine is not None:
            yield from ended(now, machine, answers)

    return rows


def _by_range(rows: DataFrame, *order: str) -> DataFrame:
    return rows.repartition("lang", "part").sortWithinPartitions("lang", "part", *order)


def phrase_counts(docs: DataFrame, root: str, min_count: int = MIN_COUNT, shard_words: int = SHARD_WORDS, range_ngrams: int = RANGE_NGRAMS) -> tuple[DataFrame, DataFrame, object]:
    """Words of each language, the count transducer of each prefix range (``lang, part, machine``), and the cuts.

    ``docs``: ``lang``, ``text``, without nulls. The transducers hold the n-grams of at most ``LONGEST`` words that
    occur ``min_count`` times or more, with their counts.
    """
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = min(_MOST_BUCKETS, max(4, int(total / 6 / _BUCKET).bit_length()))
    low = 64 - 32 - buckets

    def frequent(name: str, usual: _Filter | None) -> _Filter:
        counted = docs.mapInArrow(_bucket_counts(low, min_count, shard_words, usual), "bucket bigint, keys binary, counts binary")
        keys = counted.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_frequent(min_count), "key bigint")
        return _Filter(save_table(keys, root, name))

    usual = frequent("words", None)
    pairs = frequent("pairs", usual)
    schema = "lang string, words bigint, ngrams bigint, samples array<binary>, machine binary"
    shards = save_table(docs.mapInArrow(_machines(low, shard_words, usual, pairs), schema), root, "shards")
    sample = shards.select("lang", F.explode("samples").alias("words")).orderBy(F.xxhash64("lang", "words")).limit(SAMPLES)
    ngrams = shards.agg(F.sum("ngrams")).first()[0] or 0
    ranges = max(1, -(-ngrams // range_ngrams))
    # At most SAMPLES short strings, at any data size.
    cuts = spark.sparkContext.broadcast(_chosen_cuts([(r.lang, bytes(r.words)) for r in sample.collect()], ranges))
    divided = shards.mapInArrow(_divided(cuts), "lang string, part bigint, machine binary")
    counts = _by_range(divided).mapInArrow(_united(min_count), "lang string, part bigint, machine binary")
    return shards.groupBy("lang").agg(F.sum("words").alias("n")), save_table(counts, root, "counts"), cuts


def mine_collocations(
    docs: DataFrame, min_count: int = MIN_COUNT, cover_percent: int = COVER_PERCENT, scale: int = SCALE, lang_col: str = "lang",
    text_col: str = "text", shard_words: int = SHARD_WORDS, range_ngrams: int = RANGE_NGRAMS, root: str | None = None,
) -> DataFrame:
    """``lang, phrase, length, a, l, r, n, score``: the phrases of 2 to ``LONGEST`` words that stand on their own.

    ``a`` is the phrase's count in its language, at least ``min_count``; ``l`` and ``r`` are the counts of the two parts
    that give the lowest ``score``, ``scale * a * a / (l * r)`` rounded down (ties: the shortest first part); ``n`` is the
    number of words of the language. A phrase inside a longer candidate whose count is ``cover_percent`` of its own or
    more is left out. All arithmetic is in whole numbers.

    Null texts count as empty, a null language as ``und``; repeated rows count again. An empty table gives an empty
    result; other columns are not read.
    """
    root = root or scratch_root(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN_LANGUAGE)).alias("lang"), whole(text_col).alias("text"))
    words, counts, cuts = phrase_counts(rows, root, min_count, shard_words, range_ngrams)
    four = "lang string, part bigint, back bigint, machine binary"
    own = counts.select("lang", "part", F.lit(-1).cast("bigint").alias("back"), "machine")
    asked = own.unionByName(counts.mapInArrow(_asked(cuts), four))
    answers = save_table(_by_range(asked, "back").mapInArrow(_composed, four), root, "answers")
    scored = _by_range(own.unionByName(answers), "back").mapInArrow(_scored(scale), "lang string, phrase string, length int, a bigint, l bigint, r bigint, score bigint")
    scored = save_table(scored, root, "scored")

    # What a longer candidate holds: itself without its first or its last word.
    longer = scored.where(F.col("length") > 2)
    split = F.split("phrase", " ", -1)
    inner = longer.select("lang", F.col("a").alias("over"), F.explode(F.array(*(F.array_join(F.slice(split, i, F.col("length") - 1), " ") for i in (1, 2)))).alias("inside"))
    over = inner.groupBy(F.col("lang").alias("of"), "inside").agg(F.max("over").alias("over"))
    kept = scored.join(over, (F.col("lang") == F.col("of")) & (F.col("phrase") == F.col("inside")), "left").where(
        F.col("over").isNull() | (100 * F.col("over").cast("decimal(38,0)") < cover_percent * F.col("a").cast("decimal(38,0)"))
    )
    return kept.join(words.withColumnRenamed("lang", "of_lang"), F.col("lang") == F.col("of_lang")).select("lang", "phrase", "length", "a", "l", "r", "n", "score")


def best_collocations(found: DataFrame, most: int) -> DataFrame:
    """The ``most`` first of each language by score, count (both descending) and phrase, with their ``rank``."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return found.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= most)
