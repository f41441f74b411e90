"""Pairs inside a task: made from sorted groups of rows, and added up, as arrays of bounded size."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
from pyspark import cloudpickle

# Pairs that a task holds at once, in about 300 MB.
FLUSH_PAIRS = 4_000_000
# Pairs in one row of a stripe.
STRIPE_PAIRS = 1024
# Consecutive ranks of rare items whose pairs travel together.
SHELF = 128
# The largest rank for which two of them fit one 64-bit number.
PACKED = 1 << 31

Arrays = tuple[np.ndarray, np.ndarray, np.ndarray]


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Products of counts; one beyond 64 bits is an error."""
    if len(left) and int(left.max()) * int(right.max()) >= 1 << 63 and (left.astype(float) * right >= 2.0**63).any():
        raise OverflowError("the support of a pair passes 64 bits")
    return left * right


def added_up(b: np.ndarray, a: np.ndarray, support: np.ndarray) -> Arrays:
    """Each pair once, with the sum of its support, sorted by (b, a); a sum beyond 64 bits is an error."""
    if not len(b):
        return b, a, support
    packed = max(int(a.max()), int(b.max())) < PACKED
    once = bool((support == 1).all())
    if packed and once:
        keys = np.sort(b << 32 | a)
    elif packed:
        keys = b << 32 | a
        order = np.argsort(keys, kind="stable")
        keys, support = keys[order], support[order]
    else:
        order = np.lexsort((a, b))
        a, b, support = a[order], b[order], support[order]
    differs = keys[1:] != keys[:-1] if packed else (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    first = np.concatenate(([0], np.flatnonzero(differs) + 1))
    if packed:
        keys = keys[first]
        b, a = keys >> 32, keys & 0xFFFFFFFF
    else:
        b, a = b[first], a[first]
    if once:
        return b, a, np.diff(first, append=len(support))
    if int(support.max()) * len(support) >= 1 << 63 and (np.add.reduceat(support.astype(float), first) >= 2.0**63).any():
        raise OverflowError("the support of a pair passes 64 bits")
    return b, a, np.add.reduceat(support, first)


def _numbers(batch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64)


def _pairs_of(batch) -> tuple[np.ndarray, ...]:
    """``b, part, a, support`` of all pairs in a batch of stripes; without supports they are 1 throughout."""
    others, supports = batch.column("others"), batch.column("supports")
    lengths = others.value_lengths().to_numpy(zero_copy_only=False)
    b, part = (np.repeat(_numbers(batch, n), lengths) for n in ("b", "part"))
    a, counts = (lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for lists in (others, supports))
    support = np.ones(len(a), dtype=np.int64)
    support[np.repeat(supports.value_lengths().to_numpy(zero_copy_only=False) > 0, lengths)] = counts
    return b, part, a, support


def made_pairs(rows: dict[str, np.ndarray], flush: int) -> Iterator[Arrays]:
    """``b, a, support`` of the pairs in whole groups of rows that are sorted by rank, at most about ``flush`` at a time.

    A row that may lead is paired with the later rows of its group that may follow and have another rank.
    """
    starts = np.flatnonzero(rows["starts"])
    ends = np.repeat(np.append(starts[1:], len(rows["starts"])), np.diff(np.append(starts, len(rows["starts"]))))
    later = np.where(rows["leads"] > 0, ends - np.arange(len(ends)) - 1, 0)
    upto = np.cumsum(later)
    low = 0
    while low < len(later):
        done = upto[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(upto, done + flush, side="right")))
        counts = later[low:high]
        left = np.repeat(np.arange(low, high), counts)
        right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(counts) - counts, counts)
        a, b = rows["rank"][left], rows["rank"][right]
        kept = (a != b) & (rows["follows"][right] > 0)
        if not kept.all():
            left, right, a, b = left[kept], right[kept], a[kept], b[kept]
        yield b, a, products(rows["times"][left], rows["times"][right])
        low = high


def pair_stripes(narrow: bool, flush: int = FLUSH_PAIRS, stripe: int = STRIPE_PAIRS) -> Callable[[Iterator], Iterator]:
    """For ``mapInArrow``: the pairs of sorted groups, added up as far as a task holds them, as stripes.

    A stripe is an item ``b``, the more popular items ``a`` that it was met with and the support of each, which is left
    empty where all of it is 1, as it mostly is. An item's
    partners are divided over its ``parts``. Rows: ``starts`` (first row of a group), ``rank``, ``times``, ``leads``,
    ``follows``, ``parts``. ``narrow``: ranks fit 32 bits.
    """
    names = ("starts", "rank", "times", "leads", "follows", "parts")

    def stripes(held: list[Arrays], ranks: np.ndarray, parts: np.ndarray):
        import pyarrow as pa

        b, a, support = added_up(*(np.concatenate(arrays) for arrays in zip(*held)))
        part = np.zeros(len(b), dtype=np.int64)
        if len(ranks):
            found = np.minimum(np.searchsorted(ranks, b), len(ranks) - 1)
            part = np.where(ranks[found] == b, a % parts[found], 0)
            order = np.lexsort((a, part, b))
            b, a, support, part = b[order], a[order], support[order], part[order]
        changes = np.flatnonzero((b[1:] != b[:-1]) | (part[1:] != part[:-1])) + 1
        first = np.concatenate(([0], changes)) if len(b) else np.zeros(0, dtype=np.int64)
        within = np.arange(len(b)) - np.repeat(first, np.diff(first, append=len(b)))
        first = np.flatnonzero(within % stripe == 0)
        lengths = np.diff(first, append=len(b))
        counted = np.maximum.reduceat(support, first) > 1 if len(first) else np.zeros(0, dtype=bool)
        offsets, given = (pa.array(np.append(0, np.cumsum(n)).astype(np.int32)) for n in (lengths, lengths * counted))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(b[first]),
                pa.array(part[first].astype(np.int32)),
                pa.ListArray.from_arrays(offsets, pa.array(a.astype(np.int32) if narrow else a)),
                pa.ListArray.from_arrays(given, pa.array(support[np.repeat(counted, lengths)])),
            ],
            names=["b", "part", "others", "supports"],
        )

    def run(batches: Iterator) -> Iterator:
        nothing = np.zeros(0, dtype=np.int64)
        held: list[Arrays] = []
        size, ranks, parts = 0, nothing, nothing

        def groups():
            open_rows = dict.fromkeys(names, nothing)
            for batch in batches:
                rows = {n: np.concatenate((open_rows[n], _numbers(batch, n))) for n in names}
                starts = np.flatnonzero(rows["starts"])
                whole = starts[-1] if len(starts) else 0
                open_rows = {n: v[whole:] for n, v in rows.items()}
                if whole:
                    yield {n: v[:whole] for n, v in rows.items()}
            if len(open_rows["starts"]):
                yield open_rows

        for rows in groups():
            divided = rows["parts"] > 1
            if divided.any():
                ranks, at = np.unique(np.append(ranks, rows["rank"][divided]), return_index=True)
                parts = np.append(parts, rows["parts"][divided])[at]
            for pairs in made_pairs(rows, flush):
                held.append(pairs)
                size += len(pairs[0])
                if size >= flush:
                    yield stripes(held, ranks, parts)
                    held, size = [], 0
        if held:
            yield stripes(held, ranks, parts)

    return run


def supported_pairs(least: int, flush: int = FLUSH_PAIRS) -> Callable[[Iterator], Iterator]:
    """For ``mapInArrow``: adds up stripes that are sorted by (b, part); rows ``a, b, pair_support``.

    Stripes without supports have a support of 1 throughout. Of a (b, part) held whole only pairs with ``least`` support are given. One with more pairs than a task holds is
    given in several portions, in full: a pair may be in more than one of them, and they have to be added up.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: list[tuple[np.ndarray, ...]] = []
        size, cut = 0, None

        def given(b, a, support):
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(support)], names=["a", "b", "pair_support"])

        def flushed(last: bool):
            """Gives what is complete, and keeps the last (b, part) unless it alone is too large."""
            nonlocal held, size, cut
            b, part, a, support = (np.concatenate(arrays) for arrays in zip(*held))
            changes = np.flatnonzero((b[1:] != b[:-1]) | (part[1:] != part[:-1])) + 1
            # The group that was begun in an earlier portion, the groups held whole, the one still open.
            begun = 0
            if cut is not None and (b[0], part[0]) == cut:
                begun = changes[0] if len(changes) else len(b)
            whole = len(b) if last else (changes[-1] if len(changes) else 0)
            whole = max(whole, begun)
            if begun:
                yield given(*added_up(b[:begun], a[:begun], support[:begun]))
            if whole > begun:
                pairs = added_up(b[begun:whole], a[begun:whole], support[begun:whole])
                kept = pairs[2] >= least
                yield given(*(values[kept] for values in pairs))
            held, size = [], 0
            if whole < len(b):
                at, b_open = (b[whole], part[whole]), b[whole:]
                pairs = added_up(b_open, a[whole:], support[whole:])
                if len(pairs[0]) * 2 > flush:
                    cut = at
                    yield given(*pairs)
                else:
                    held = [(pairs[0], np.full(len(pairs[0]), at[1]), pairs[1], pairs[2])]
                    size = len(pairs[0])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(_pairs_of(batch))
            size += len(held[-1][0])
            if size >= flush:
                yield from flushed(False)
        if held:
            yield from flushed(True)

    return run


def byte_lengths(values: np.ndarray) -> np.ndarray:
    """How many bytes :func:`as_bytes` gives each number."""
    lengths = np.ones(len(values), dtype=np.int64)
    bits = 7
    while bits < 63 and len(values) and int(values.max()) >> bits:
        lengths += values >= 1 << bits
        bits += 7
    return lengths


def as_bytes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers from 0 on as bytes, seven bits each, the last one below 128; and how many bytes each number has."""
    lengths = byte_lengths(values)
    starts = np.cumsum(lengths) - lengths
    data = np.zeros(int(lengths.sum()), dtype=np.uint8)
    for at in range(int(lengths.max()) if len(values) else 0):
        has = lengths > at
        data[starts[has] + at] = (values[has] >> 7 * at & 127) | np.where(lengths[has] > at + 1, 128, 0)
    return data, lengths


def of_bytes(data: np.ndarray) -> np.ndarray:
    """The numbers of :func:`as_bytes`."""
    ends = np.flatnonzero(data < 128)
    starts = np.append(0, ends[:-1] + 1)[: len(ends)]
    lengths = ends - starts + 1
    values = np.zeros(len(ends), dtype=np.int64)
    for at in range(int(lengths.max()) if len(ends) else 0):
        has = lengths > at
        values[has] |= (data[starts[has] + at] & 127).astype(np.int64) << 7 * at
    return values


def _shelf_starts(shelves: np.ndarray, lone: int, shelf: int) -> np.ndarray:
    """The first rank of each shelf: ranks up to ``lone`` are shelves of their own, then each has ``shelf`` ranks."""
    return np.where(shelves <= lone, shelves, lone + 1 + (shelves - lone - 1) * shelf)


def shelved(stripes: Callable[[Iterator], Iterator], lone: int, shelf: int = SHELF, stripe: int = STRIPE_PAIRS) -> Callable[[Iterator], Iterator]:
    """For ``mapInArrow``: what :func:`pair_stripes` gives, in fewer bytes. Items beyond rank ``lone`` have one part.

    A rare item meets few others in a task, so a row of its own costs more than its pairs. Here ``b`` is a shelf of
    neighbouring items. As ``a`` comes before ``b``, a pair is a number, the place of ``b`` on the shelf times the ranks up
    to the shelf's end plus ``a``. Of the steps from each number to the next, ``lows`` has the lowest bytes as they are, as
    many as make all of it shortest, and ``others`` the rest by :func:`as_bytes`; ``supports`` are empty where all are 1.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in stripes(batches):
            b, part, a, support = _pairs_of(batch)
            if not len(b):
                continue
            shelves = np.where(b <= lone, b, lone + 1 + (b - lone - 1) // shelf)
            starts = _shelf_starts(shelves, lone, shelf)
            width = np.where(shelves <= lone, 1, shelf)
            number = (b - starts) * (starts + width) + a
            changes = np.flatnonzero((shelves[1:] != shelves[:-1]) | (part[1:] != part[:-1])) + 1
            first = np.append(0, changes)
            within = np.arange(len(b)) - np.repeat(first, np.diff(first, append=len(b)))
            first = np.flatnonzero(within % stripe == 0)
            steps = np.diff(number, prepend=0)
            steps[first] = number[first]
            lengths = np.diff(first, append=len(b))
            counted = np.maximum.reduceat(support, first) > 1
            whole = min(range(8), key=lambda n: n * len(steps) + int(byte_lengths(steps >> 8 * n).sum()))
            lows = np.ascontiguousarray(steps.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :whole])
            offsets = (np.append(first, len(b)) * whole).astype(np.int32)
            columns = [pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(lows)])]
            for values, own in ((steps >> 8 * whole, np.arange(len(b))), (support, np.flatnonzero(np.repeat(counted, lengths)))):
                data, sizes = as_bytes(values[own])
                at = np.zeros(len(b), dtype=np.int64)
                at[own] = sizes
                offsets = np.append(0, np.cumsum(np.add.reduceat(at, first))).astype(np.int32)
                columns.append(pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(data)]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(shelves[first]), pa.array(part[first].astype(np.int32)), *columns], names=["b", "part", "lows", "others", "supports"]
            )

    return run


def unshelved(supported: Callable[[Iterator], Iterator], lone: int, shelf: int = SHELF) -> Callable[[Iterator], Iterator]:
    """For ``mapInArrow``: :func:`supported_pairs` of rows by :func:`shelved`, which adds up the numbers of pairs."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        def lists(column):
            """Numbers of each row, as lists; the bytes of a column may begin anywhere in its buffer."""
            sizes = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
            data = np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8)
            upto = np.append(0, np.cumsum(data < 128))
            return of_bytes(data), upto[np.append(0, np.cumsum(sizes))]

        def with_lows(high, upto, column):
            sizes = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
            data = np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8)
            lengths = np.diff(upto)
            whole = np.repeat(sizes // lengths, lengths)
            starts = np.cumsum(whole) - whole
            steps = high << 8 * whole
            for at in range(int(whole.max())):
                has = whole > at
                steps[has] |= data[starts[has] + at].astype(np.int64) << 8 * at
            return steps

        def opened():
            for batch in batches:
                if not batch.num_rows:
                    continue
                (steps, upto), (support, given) = (lists(batch.column(n)) for n in ("others", "supports"))
                steps = with_lows(steps, upto, batch.column("lows"))
                total = np.cumsum(steps)
                before = total[upto[:-1]] - steps[upto[:-1]]
                number = total - np.repeat(before, np.diff(upto))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("b"),
                        batch.column("part"),
                        pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.array(number)),
                        pa.ListArray.from_arrays(pa.array(given.astype(np.int32)), pa.array(support)),
                    ],
                    names=["b", "part", "others", "supports"],
                )

        for pairs in supported(opened()):
            number, shelves = _numbers(pairs, "a"), _numbers(pairs, "b")
            starts = _shelf_starts(shelves, lone, shelf)
            upto = starts + np.where(shelves <= lone, 1, shelf)
            yield pa.RecordBatch.from_arrays(
                [pa.array(number % upto), pa.array(starts + number // upto), pairs.column("pair_support")], names=["a", "b", "pair_support"]
            )

    return run


# Executors run the functions above as they are here, whether or not they have this library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
