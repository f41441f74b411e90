from __future__ import annotations

import re
from collections import Counter, defaultdict
from random import Random

import pytest

from basketry.llm.mixing import BUCKET, _flight, _landing, mix, mixed_documents, word_count
from tests.conftest import rows

SF = "/root/testdata/sf0.1"


def targets(sizes, weights=(3, 1, 2), share=1.5, limit=2):
    """The excess shared again by weight until no source is above its limit."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[at % len(weights)] for at, s in enumerate(order)}
    left, free, found = share * sum(sizes.values()), set(sizes), {}
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > limit * sizes[s]}
        if not over:
            found |= {s: left * weight[s] / total for s in free}
            break
        for s in over:
            found[s] = limit * sizes[s]
        left -= sum(found[s] for s in over)
        free -= over
    return found


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def check(docs, found, close):
    sizes = defaultdict(int)
    for r in docs:
        sizes[r.source] += words(r.text)
    expected, taken = targets(sizes), defaultdict(int)
    assert Counter(r.doc_id for r in docs) == Counter(r.doc_id for r in found)
    text = {r.doc_id: r for r in docs}
    for r in found:
        assert r["size"] == words(text[r.doc_id].text) and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(expected[r.source])
        assert 0 <= r.copies <= 2 and r.taken == r.copies * r["size"]
        taken[r.source] += r.taken
    for source, target in expected.items():
        assert abs(taken[source] - target) <= max(close * target, 3), source


def test_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check(docs.collect(), mix(docs).collect(), 0.002)


def test_large_source_and_reruns(spark):
    """More buckets than one: the units that these leave fly on together."""
    draw = Random(4)
    data = [(n, "w " * draw.randint(0, 90), "big" if n % 3 else draw.choice(["a", "b", None])) for n in range(4 * BUCKET)]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, source string")
    found = mix(docs).collect()
    check(docs.collect(), found, 0.001)
    assert rows(mix(docs.repartition(5))) == sorted(map(tuple, found), key=lambda t: [(v is not None, str(type(v)), v) for v in t])
    # Balanced in documents too.
    copies = sum(r.copies for r in found if r.source == "big")
    big = [r for r in found if r.source == "big"]
    assert abs(copies - len(big) * big[0].target / big[0].source_size) < 0.02 * len(big)


def test_flight_keeps_both_totals():
    draw = Random(1)
    tokens, counts = [float(draw.randint(0, 500)) for _ in range(300)], [1.0] * 300
    start = [0.37] * 300
    flown = _flight(tokens, counts, start, draw)
    assert sum(0 < p < 1 for p in flown) <= 2
    assert sum(flown) == pytest.approx(sum(start)) and sum(p * t for p, t in zip(flown, tokens)) == pytest.approx(0.37 * sum(tokens))
    landed = _landing(tokens, counts, flown)
    assert set(landed) <= {0.0, 1.0}
    same = _flight([5.0] * 40, [1.0] * 40, [0.25] * 40, draw)
    assert sum(same) == pytest.approx(10) and sum(0 < p < 1 for p in same) <= 2


def test_edges(documents, clashing, spark):
    docs = documents((1, None, "a"), (2, "", "a"), (3, "x\x1fy z\x85w\x0bv", "b"), (None, "one two", "b"), (4, "w " * 50_000, None), (5, "w", "c"), (5, "w", "c"))
    docs = clashing(docs)
    found = mix(docs)
    assert rows(found, "doc_id", "size") == rows(docs.select("doc_id", word_count("text").alias("s")), "doc_id", "s")
    assert {r.source: r.target for r in found.collect()}["a"] == 0
    assert all(r.taken <= 2 * r["size"] for r in found.collect())
    assert mix(docs.limit(0)).count() == 0
    assert {r.taken for r in mix(documents((1, None, "a"), (2, " ", None))).collect()} == {0}
    mixed = mixed_documents(docs)
    assert mixed.columns == docs.columns
    counts = Counter(r.doc_id for r in mixed.collect())
    assert counts == Counter({i: c for i, c in Counter(x for r in found.collect() for x in [r.doc_id] * r.copies).items()})
