"""Rows that may hold the first known values of their group, found inside a task."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
from pyspark import cloudpickle

# Rows, and bytes, that a task compares at once.
PORTION_ROWS = 1_000_000
PORTION_BYTES = 200_000_000


def first_holders(
    group: str, order: Sequence[str], known: str, values: Mapping[str, int], rows: int = PORTION_ROWS, size: int = PORTION_BYTES
) -> Callable[[Iterator], Iterator]:
    """For ``mapInArrow``: the rows of a portion that hold the first known value of something in their group.

    ``known`` has a bit for each attribute that a row knows, ``order`` are numbers, smallest first. A row stays if it is the
    first of its group to know an attribute; of rows that tie, all stay, and of a group that knows nothing one row. ``values``
    are columns with the bits of the attributes made of them: where none of these is first, the column is emptied.
    So a group leaves a portion as no more rows than it has attributes, but for ties, however many it came with.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        def holders(table):
            code = table.column(group).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
            keys = [code, *(table.column(c).to_numpy() for c in order)]
            at = np.lexsort(keys[::-1])
            differs = [np.append(True, k[at][1:] != k[at][:-1]) for k in keys]
            place = np.cumsum(np.logical_or.reduce(differs))
            starts = np.flatnonzero(differs[0])
            lengths = np.diff(starts, append=len(at))
            bits = table.column(known).to_numpy()[at].astype(np.int64)
            first = np.zeros(len(at), dtype=np.int64)
            for bit in range(int(bits.max()).bit_length()):
                of_known = np.where(bits >> bit & 1, place, len(at) + 1)
                least = np.repeat(np.minimum.reduceat(of_known, starts), lengths)
                first |= (of_known == least).astype(np.int64) * (bits & 1 << bit)
            kept = first > 0
            kept[starts[~np.logical_or.reduceat(kept, starts)]] = True
            table, first = table.take(pa.array(at[kept])), first[kept]
            for column, own in values.items():
                n = table.column_names.index(column)
                held = table.column(n)
                table = table.set_column(n, table.schema.field(n).with_nullable(True), pc.if_else(pa.array(first & own > 0), held, pa.scalar(None, held.type)))
            # Rows alike lie together, so that the shuffle packs them better: columns with the fewest values count first.
            codes = [table.column(c).combine_chunks().dictionary_encode() for c in values]
            codes.sort(key=lambda code: -len(code.dictionary))
            alike = np.lexsort([pc.fill_null(code.indices, -1).to_numpy(zero_copy_only=False) for code in codes])
            yield from table.take(pa.array(alike)).combine_chunks().to_batches(max_chunksize=10_000)

        held: list = []
        n = nbytes = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            n, nbytes = n + batch.num_rows, nbytes + batch.nbytes
            if n >= rows or nbytes >= size:
                yield from holders(pa.Table.from_batches(held))
                held, n, nbytes = [], 0, 0
        if held:
            yield from holders(pa.Table.from_batches(held))

    return run


# Executors run the function above as it is here, whether or not they have this library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
