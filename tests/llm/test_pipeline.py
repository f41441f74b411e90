from __future__ import annotations

from collections import Counter

import pytest

import corpus_pipeline
from basketry.llm.decontaminate import contaminated
from basketry.llm.mixing import mix
from basketry.llm.quality import fit_quality, score_quality
from tests.llm.test_near_dedup import brute

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage was given and what it returned."""
    root = tmp_path_factory.mktemp("stages")
    docs, found = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        result = stage(spark, docs, SF)
        assert result.columns == docs.columns
        result.write.parquet(f"{root}/{name}")
        result = spark.read.parquet(f"{root}/{name}")
        found[name] = (docs, result)
        docs = result
    return found


def texts(frame):
    return {r.doc_id: r.text for r in frame.collect()}


def test_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "decontamination", "mixing"]


def test_quality(spark, stages):
    given, kept = stages["quality"]
    model = fit_quality(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    expected = {r.doc_id for r in score_quality(given, model).collect() if r.predicted}
    assert set(texts(kept)) == expected and len(expected) < given.count()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert all(i in expected for i, q in labels.items() if q == 1)


def test_exact(stages):
    given, kept = (texts(f) for f in stages["exact_dedup"])
    first = {}
    for doc_id in sorted(given):
        first.setdefault(given[doc_id], doc_id)
    assert set(kept) == set(first.values()) and len(kept) < len(given)


def test_near(stages):
    given, kept = (texts(f) for f in stages["near_dedup"])
    assert set(kept) == {i for i, _, _, stays in brute(list(given.items()), 5) if stays}
    assert len(kept) < len(given)


def test_decontamination(spark, stages):
    given, kept = stages["decontamination"]
    leaks = {r.doc_id for r in contaminated(given, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert leaks and set(texts(kept)) == set(texts(given)) - leaks


def test_mixing(stages):
    given, taken = stages["mixing"]
    copies = {r.doc_id: r.copies for r in mix(given).collect()}
    assert Counter(r.doc_id for r in taken.collect()) == Counter({i: c for i, c in copies.items() if c})


def test_query(spark, stages):
    found = corpus_pipeline.run(spark, SF)
    assert Counter(r.doc_id for r in found.collect()) == Counter(r.doc_id for r in stages["mixing"][1].collect())


def test_rows_with_nulls_and_repeats_pass(spark, tmp_path):
    """Documents of odd shapes go through every stage."""
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    odd = [(1, None, None, None, None), (None, "some words of a text", "en", None, -1), (2, "", "en", "a", 0), (2, "", "en", "a", 0), (3, "w " * 70_000, None, "a", 140_000)]
    spark.createDataFrame(odd, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(None, None)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} <= {1, None, 2, 3}
    # Columns with the names that the stages might use themselves.
    from pyspark.sql import functions as F

    clash = tmp_path / "clash"
    names = ["__key", "__sha", "__gone", "__id", "__words", "__copies", "__copy", "__own0", "__own1", "score", "kept", "hash", "n", "size", "node", "component_id"]
    given = spark.read.parquet(f"{tmp_path}/documents.parquet").withColumns({n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in names})
    given.write.parquet(f"{clash}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/{name}.parquet").write.parquet(f"{clash}/{name}.parquet")
    found = corpus_pipeline.run(spark, str(clash))
    assert found.columns == given.columns
    for row in found.collect():
        assert [row[n] for n in names] == [None if row.doc_id is None else f"{n}{row.doc_id}" for n in names]
    empty = tmp_path / "empty"
    spark.createDataFrame([], schema).write.parquet(f"{empty}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/{name}.parquet").write.parquet(f"{empty}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(empty)).count() == 0
