from __future__ import annotations

import zlib
from itertools import combinations

import numpy as np
import pytest

from basketry.llm.quality import FACTORS, SLOTS, FactorisationMachine, fit_quality, keep_quality, score_quality
from tests.conftest import rows

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def table(spark):
    return {t: spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels")}


@pytest.fixture(scope="module")
def model(table):
    return fit_quality(table["documents"], table["labels"], sample=2000)


def test_sum_of_squares_identity():
    draw = np.random.default_rng(3)
    machine = FactorisationMachine(0.3, draw.normal(size=SLOTS), draw.normal(size=(SLOTS, FACTORS)))
    slots, values = draw.choice(SLOTS, 12, replace=False), draw.normal(size=12)
    plain = 0.3 + machine.weights[slots] @ values
    plain += sum(machine.factors[slots[i]] @ machine.factors[slots[j]] * values[i] * values[j] for i, j in combinations(range(12), 2))
    assert machine.scores(slots, values, np.array([0]))[0] == pytest.approx(1 / (1 + np.exp(-plain)))


def test_held_out_accuracy(table, model):
    scored = score_quality(table["documents"], model)
    labels = {r.doc_id: r.quality for r in table["labels"].collect()}
    found = [(r.score, r.predicted, labels[r.doc_id]) for r in scored.where("held_out").collect() if r.doc_id in labels]
    good, bad = ([f for f in found if f[2] == label] for label in (1, 0))
    assert len(bad) > 50 and len(good) > 300
    assert np.mean([p for _, p, _ in good]) > 0.99 and np.mean([p for _, p, _ in bad]) < 0.1
    assert np.mean([g[0] > b[0] for g in good for b in bad]) > 0.99


def test_held_out_rows_and_training(table):
    """Ids held out follow from their crc32; wrong labels there change nothing."""
    from pyspark.sql import functions as F

    docs, labels = table["documents"].where("doc_id < 600"), table["labels"].where("doc_id < 600")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    spoilt = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = fit_quality(docs, labels, 100), fit_quality(docs, spoilt, 100)
    assert one.bias == two.bias and (one.weights == two.weights).all() and (one.factors == two.factors).all()
    for row in score_quality(docs, one).collect():
        assert row.held_out == (zlib.crc32(str(row.doc_id).encode()) % 5 == 0)
        assert row.predicted == int(row.score >= 0.3) and 0 <= row.score <= 1


def test_label_source_and_id_are_no_inputs(documents, model):
    one = documents((1, "the words of a text", "a"))
    two = documents((2, "the words of a text", "b")).withColumnRenamed("lang", "language")
    assert [r.score for r in score_quality(one, model).collect()] == [r.score for r in score_quality(two, model).collect()]


def test_edges(spark, documents, clashing, model, prose):
    docs = clashing(documents((1, None), (2, ""), (None, prose(50, 1)), (3, prose(60_000, 2)), (3, prose(60_000, 2)), (4, "| " * 500)))
    found = score_quality(docs, model).collect()
    assert len(found) == 6 and all(0 <= r.score <= 1 for r in found)
    assert len({r.score for r in found if r.doc_id == 3}) == 1
    assert score_quality(docs.drop("n_chars"), model).count() == 6
    assert score_quality(docs.limit(0), model).count() == 0
    kept = keep_quality(docs, model)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == sorted(r.doc_id or 0 for r in found if r.predicted)
    nothing = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    blank = fit_quality(docs, nothing)
    assert {r.score for r in score_quality(docs, blank).collect()} == {0.5}
    odd = spark.createDataFrame([(1, None, 0), (None, 1, 0), (2, 7, 0), (3, 1, 0), (3, 1, 0)], "doc_id bigint, quality int, toxic int")
    assert {r.score > 0.5 for r in score_quality(docs, fit_quality(docs, odd)).collect()} == {True}


def test_a_repeated_id_is_learnt_once(spark, documents, monkeypatch):
    """The sample bounds what the driver gathers, however often an id stands in the documents."""
    import basketry.llm.quality as quality

    learnt = []
    monkeypatch.setattr(quality, "train", lambda documents, labels: learnt.append((len(documents), labels.tolist())))
    docs = documents(*[(1, f"text {i % 7}") for i in range(3000)], *[(i, f"other {i}") for i in range(2, 12)])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 12)], "doc_id bigint, quality int, toxic int")
    fit_quality(docs, labels, sample=5)
    assert learnt[0][0] == len(learnt[0][1]) == 5


def test_scores_do_not_depend_on_parts(documents, model, prose, monkeypatch):
    import basketry.llm.quality as quality

    docs = documents(*[(i, prose(20 * i, i)) for i in range(40)]).coalesce(1)
    whole = rows(score_quality(docs, model))
    monkeypatch.setattr(quality, "PART_ROWS", 3)
    monkeypatch.setattr(quality, "PART_CHARS", 500)
    assert rows(score_quality(docs, model)) == whole
    parts = list(quality._parts(quality.Features(), *[__import__("pyarrow").array(c) for c in (["x" * 300] * 5, [None] * 5)]))
    assert [len(p) for p in parts] == [1] * 5


def test_whole_scores_by_plain_sums(documents, model, prose):
    """Every pair of features by its inner product, for whole texts, against the query's scores."""
    from basketry.llm.quality import Features, vector

    texts = {i: prose(5 + 9 * i, i) + ("| |" if i % 2 else ". 12 X") for i in range(8)}
    for row in score_quality(documents(*texts.items()), model).collect():
        slots, values = vector(*Features().parts(texts[row.doc_id], len(texts[row.doc_id])))
        total = model.bias + sum(model.weights[s] * v for s, v in zip(slots, values))
        total += sum(model.factors[slots[i]] @ model.factors[slots[j]] * values[i] * values[j] for i, j in combinations(range(len(slots)), 2))
        assert row.score == pytest.approx(1 / (1 + np.exp(-np.clip(total, -30, 30))), abs=1e-9)
