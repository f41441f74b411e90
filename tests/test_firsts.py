"""Occurrences that may hold the first known values of their item."""

import os
import random
import subprocess
import sys

import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from basketry.functions.firsts import first_holders
from basketry.operators import item_dimension
from basketry.sources.documents import collections_of
from tests.conftest import rows

VALUES = {"x": 0b001, "y": 0b110}


def batches(data, n):
    for at in range(0, len(data), n):
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*data[at : at + n])], names=["of", "a", "b", "known", "x", "y"])


def firsts(data):
    """Group -> bit -> the smallest place and the values held there."""
    found = {group: {} for group, *_ in data}
    for group, a, b, known, x, y in data:
        for bit, value in ((1, x), (2, y), (4, y)):
            if known & bit:
                place, held = found[group].get(bit, ((a, b), set()))
                if (a, b) <= place:
                    found[group][bit] = ((a, b), (held if (a, b) == place else set()) | {value})
    return found


@pytest.mark.parametrize("portion", [1, 7, 50, 10_000])
def test_first_values_stay(portion):
    rng = random.Random(portion)
    data = [(f"g{rng.randint(0, 9)}", rng.randint(-2, 2), rng.randint(0, 3), rng.randint(0, 7), f"x{rng.randint(0, 5)}", f"y{rng.randint(0, 5)}") for _ in range(300)]
    data += [("nothing", 5, 5, 0, "x", "y")] * 3
    kept = [tuple(r.values()) for batch in first_holders("of", ("a", "b"), "known", VALUES, rows=portion)(batches(data, 5)) for r in batch.to_pylist()]
    assert firsts(kept) == firsts(data)
    assert {r[:4] for r in kept} <= {r[:4] for r in data} and ("nothing", 5, 5, 0, None, None) in kept
    if portion == 10_000:
        places = {g: {place for place, _ in f.values()} for g, f in firsts(data).items()}
        assert all(r[0] == "nothing" or (r[1], r[2]) in places[r[0]] for r in kept) and len(kept) < 100
        assert [r for r in kept if r[0] == "nothing"] == [("nothing", 5, 5, 0, None, None)]
        assert any(r[4] is None for r in kept) and any(r[5] is None for r in kept)


def test_executors_need_no_library():
    code = "import sys; from pyspark import cloudpickle; f = cloudpickle.loads(sys.stdin.buffer.read()); print(list(f(iter([]))), 'basketry' in sys.modules)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", code], input=cloudpickle.dumps(first_holders("of", ("a",), "known", VALUES)), capture_output=True, cwd="/", env=env)
    assert run.stdout.split() == [b"[]", b"False"], run.stderr


def test_occurrences_are_not_sorted_before_they_travel(spark):
    """All of a task's occurrences at once would have to fit its memory, or go to disk; a hot item is few rows of a task."""
    items = F.transform(
        F.sequence(F.lit(0), F.lit(1999)),
        lambda n: F.struct(
            F.lit(" x:a:1").alias("track_uri"), F.lit("n").alias("track_name"), F.when(n > 900, F.lit("x:b:")).alias("artist_uri"), F.lit(" ").alias("artist_name"),
            F.lit(None).cast("string").alias("album_uri"), F.lit(None).cast("string").alias("album_name"), n.cast("long").alias("duration_ms"), (n % 1500).cast("long").alias("pos"),
        ),
    )
    playlists = F.array(F.struct(F.col("id").alias("pid"), items.alias("tracks")))
    found = item_dimension(collections_of(spark.range(0, 40, 1, 4).select(F.lit("f").alias("source_file"), playlists.alias("playlists"))))
    below = found._jdf.queryExecution().executedPlan().toString().split("Exchange hashpartitioning(of", 1)[1]
    assert "MapInArrow" in below and "Sort" not in below and "Aggregate" not in below
    assert rows(found) == [("x:a:1", "1", "n", "x:b:", None, None, None, None, None, 0)]
