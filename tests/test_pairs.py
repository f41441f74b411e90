"""Counting pairs in a task: portions, parts and stripes small enough to be crossed."""

import os
import random
import subprocess
import sys
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from basketry.functions.pairs import PACKED, STRIPE_PAIRS, added_up, as_bytes, of_bytes, pair_stripes, products, shelved, supported_pairs, unshelved
from basketry.operators import cooccurrence_pairs, item_popularity
from basketry.operators.cooccurrence import sized_items
from basketry.sources.tables import save_table, scratch_root
from tests.conftest import rows


def made(groups, batch_rows, parts):
    """Batches of the sorted rows of ``groups``: rank -> (times, leads, follows)."""
    flat = [
        (n == 0, rank, *group[rank], parts.get(rank, 1)) for group in groups for n, rank in enumerate(sorted(group))
    ]
    names = ["starts", "rank", "times", "leads", "follows", "parts"]
    for at in range(0, len(flat), batch_rows):
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*flat[at : at + batch_rows])], names=names)


@pytest.mark.parametrize("batch_rows, flush, stripe, shift", [(1000, 10**6, 1024, 0), (3, 7, 2, 0), (5, 1, 1, 0), (4, 30, 3, 2**33)])
@pytest.mark.parametrize("most", [1, 4])
def test_stripes_add_up_to_the_pairs(batch_rows, flush, stripe, shift, most):
    rng = random.Random(3)
    groups = [{rng.randint(1, 25) + shift: (rng.randint(1, most), int(rng.random() < 0.9), int(rng.random() < 0.9)) for _ in range(rng.randint(1, 12))} for _ in range(60)]
    expected = Counter()
    for group in groups:
        for a in group:
            for b in group:
                if a < b and group[a][1] and group[b][2]:
                    expected[(a, b)] += group[a][0] * group[b][0]
    parts = {rank + shift: 3 for rank in (20, 21)}
    found = list(pair_stripes(not shift, flush, stripe)(made(groups, batch_rows, parts)))
    assert all(len(other) <= stripe for batch in found for other in batch.column("others").to_pylist())
    stripes = sorted((tuple(r.values()) for batch in found for r in batch.to_pylist()), key=lambda r: r[:2])
    assert {r[1] for r in stripes if r[0] in parts} == {0, 1, 2} and {r[1] for r in stripes if r[0] not in parts} == {0}
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*stripes[at : at + 4])], names=["b", "part", "others", "supports"]) for at in range(0, len(stripes), 4)]
    for least in (1, 3):
        total = Counter()
        for batch in supported_pairs(least, flush)(iter(batches)):
            for row in batch.to_pylist():
                total[(row["a"], row["b"])] += row["pair_support"]
        assert {p: n for p, n in total.items() if n >= least} == {p: n for p, n in expected.items() if n >= least}


def test_numbers_as_bytes():
    rng = random.Random(5)
    for values in ([], [0], [0, 127, 128, 2**14 - 1, 2**14, 2**62, 2**63 - 1], [rng.getrandbits(rng.randint(1, 63)) for _ in range(500)]):
        data, lengths = as_bytes(np.array(values, dtype=np.int64))
        assert of_bytes(data).tolist() == values and lengths.tolist() == [max(1, -(-v.bit_length() // 7)) for v in values]


@pytest.mark.parametrize("batch_rows, flush, stripe, shift", [(1000, 10**6, 1024, 0), (3, 7, 2, 0), (5, 1, 1, 0), (4, 30, 3, 2**33)])
@pytest.mark.parametrize("most, shelf", [(1, 4), (4, 4), (3, 1), (2, 1000)])
def test_shelves_add_up_to_the_pairs(batch_rows, flush, stripe, shift, most, shelf):
    rng = random.Random(4)
    groups = [{rng.randint(1, 25) + shift: (rng.randint(1, most), int(rng.random() < 0.9), int(rng.random() < 0.9)) for _ in range(rng.randint(1, 12))} for _ in range(60)]
    expected = Counter()
    for group in groups:
        for a in group:
            for b in group:
                if a < b and group[a][1] and group[b][2]:
                    expected[(a, b)] += group[a][0] * group[b][0]
    parts, lone = {rank + shift: 3 for rank in (6, 9)}, 9 + shift
    found = list(shelved(pair_stripes(not shift, flush, stripe), lone, shelf, stripe)(made(groups, batch_rows, parts)))
    stripes = sorted((tuple(r.values()) for batch in found for r in batch.to_pylist()), key=lambda r: r[:2])
    whole = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*stripes)], names=["b", "part", "lows", "others", "supports"])
    for least in (1, 3):
        total = Counter()
        for batch in unshelved(supported_pairs(least, flush), lone, shelf)(whole.slice(at, 4) for at in range(0, len(stripes), 4)):
            for row in batch.to_pylist():
                total[(row["a"], row["b"])] += row["pair_support"]
        assert {p: n for p, n in total.items() if n >= least} == {p: n for p, n in expected.items() if n >= least}


def test_pairs_of_rare_items_share_rows():
    """A few bytes a pair and many pairs a row, also where an item has no two pairs in a task."""
    rng = random.Random(6)
    groups = [{rng.randint(1, 200_000): (1, 1, 1) for _ in range(8)} for _ in range(3000)]
    alone, together = (list(run(made(groups, 10_000, {}))) for run in (pair_stripes(True), shelved(pair_stripes(True), 0)))
    pairs = sum(len(r) for batch in alone for r in batch.column("others"))
    assert sum(b.num_rows for b in together) * 10 < sum(b.num_rows for b in alone)
    assert sum(b.nbytes for b in together) < 4.5 * pairs < sum(b.nbytes for b in alone)
    assert all(len(of_bytes(np.frombuffer(r, np.uint8))) <= STRIPE_PAIRS for b in together for r in b.column("others").to_pylist())


def test_lowest_bytes_of_steps_stay_whole():
    """Steps of some millions, as between pairs among millions of items, would take 3.7 bytes in sevens of bits."""
    rng = random.Random(8)
    groups = [{rng.randint(1, 3_500_000): (1, 1, 0), rng.randint(3_600_000, 3_600_000 + 12_800): (1, 0, 1)} for _ in range(7000)]
    found = list(shelved(pair_stripes(True), 0)(made(groups, 10_000, {})))
    assert sum(b.column(c).nbytes - 4 * b.num_rows for b in found for c in ("lows", "others")) < 3.4 * len(groups)
    pairs = [tuple(r.values()) for batch in unshelved(supported_pairs(1), 0)(iter(found)) for r in batch.to_pylist()]
    assert sorted(pairs) == sorted((min(g), max(g), 1) for g in groups)


def test_pairs_below_the_support_leave_no_task():
    stripes = pa.RecordBatch.from_arrays([pa.array(c) for c in ([9, 9, 10], [0, 0, 0], [[1, 2], [2, 3], [2]], [[1, 2], [1, 1], [5]])], names=["b", "part", "others", "supports"])
    given = [tuple(r.values()) for batch in supported_pairs(3)(iter([stripes])) for r in batch.to_pylist()]
    assert given == [(2, 9, 3), (2, 10, 5)]


def test_support_of_one_is_left_out():
    groups = [{1: (1, 1, 1), 2: (1, 1, 1), 3: (1, 1, 1)}, {1: (1, 1, 1), 3: (1, 1, 1), 4: (2, 1, 1)}]
    (batch,) = pair_stripes(True)(made(groups, 100, {}))
    assert [tuple(r.values()) for r in batch.to_pylist()] == [(2, 0, [1], []), (3, 0, [1, 2], [2, 1]), (4, 0, [1, 3], [2, 2])]
    given = [tuple(r.values()) for found in supported_pairs(1)(iter([batch])) for r in found.to_pylist()]
    assert given == [(1, 2, 1), (1, 3, 2), (2, 3, 1), (1, 4, 2), (3, 4, 2)]


def test_support_beyond_64_bits_is_an_error():
    big = np.array([2**40, 2**40])
    with pytest.raises(OverflowError):
        products(big, big)
    for rank in (5, PACKED + 5):
        same = np.array([rank, rank])
        with pytest.raises(OverflowError):
            added_up(same, same - 1, np.array([2**62, 2**62]))
        assert added_up(same, same - 1, np.array([2**61, 2**61]))[2].tolist() == [2**62]


def test_executors_need_no_library():
    code = "import sys; from pyspark import cloudpickle; f = cloudpickle.loads(sys.stdin.buffer.read()); print(list(f(iter([]))), 'basketry' in sys.modules)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    for made_for in (pair_stripes(True), supported_pairs(3)):
        run = subprocess.run([sys.executable, "-c", code], input=cloudpickle.dumps(made_for), capture_output=True, cwd="/", env=env)
        assert run.stdout.split() == [b"[]", b"False"], run.stderr


def test_only_supported_pairs_are_grouped_as_rows(spark):
    """A pair travels as a number in a list; what Spark groups has passed the support."""
    data = [(p, f"i{(p * 7 + n * n) % 40:02d}") for p in range(60) for n in range(9)]
    train = spark.createDataFrame(data, "pid long, track_id string")
    popularity = save_table(item_popularity(train), scratch_root(spark), "popularity")
    text = cooccurrence_pairs(train, popularity)._jdf.queryExecution().executedPlan().toString()
    below = text.split("partial_sum(pair_support", 1)[1]
    assert below.split("MapInArrow", 1)[0].count("Exchange") == 0 and "others#" in below
    assert "SortMergeJoin [pid" not in text


def test_giant_collections_are_dealt_by_item(spark):
    data = [(1, f"i{n % 30:02d}") for n in range(90)] + [(p, f"i{n:02d}") for p in (2, 3) for n in range(5)] + [(4, "i00")]
    train = spark.createDataFrame(data, "pid long, track_id string")
    assert rows(sized_items(train, 8, giant_rows=20)) == rows(sized_items(train, 8))
    assert {r.pid: r.blocks for r in sized_items(train, 8, giant_rows=20).collect()} == {1: 4, 2: 1, 3: 1}
    assert sized_items(train).where(F.col("pid") == 4).isEmpty()
