import json
from math import log2

import pytest

from basketry.operators import hits_and_dcg, ideal_dcg, metrics_report, ranking_metrics
from basketry.operators.metrics import report_json
from basketry.sources.tables import write_text
from tests.conftest import rows

RECOMMENDATION = "baseline_name string, pid long, rank int, track_id string, score double"
TARGET = "pid long, track_id string"


def recommendations(spark, *data):
    return spark.createDataFrame([(b, p, r, t, 0.0) for b, p, r, t in data], RECOMMENDATION)


def test_one_hit_of_three(spark):
    recs = recommendations(spark, ("popularity", 1, 1, "a"), ("popularity", 1, 2, "x"))
    targets = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (1, "a")], TARGET)
    got = {r.baseline_name: r for r in ranking_metrics(recs, targets, [10]).collect()}
    assert got["popularity"].recall == pytest.approx(1 / 3)
    assert got["popularity"].precision == pytest.approx(0.1)
    assert got["popularity"].ndcg == pytest.approx(1 / 2.1309297535714578)
    assert tuple(got["cooccurrence"])[2:] == (0.0, 0.0, 0.0)


def test_collections_without_recommendations_count(spark):
    recs = recommendations(spark, ("popularity", 1, 1, "a"), ("popularity", 9, 1, "a"))
    targets = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, "a")], TARGET)
    got = ranking_metrics(recs, targets, [1], ["popularity"]).first()
    assert (got.recall, got.precision, got.ndcg) == (0.25, 0.25, 0.25)


def test_no_targets_no_metrics(spark):
    recs = recommendations(spark, ("popularity", 1, 1, "a"))
    assert ranking_metrics(recs, spark.createDataFrame([], TARGET), [1]).count() == 0


def test_metrics_stay_in_range_and_recall_grows(spark):
    recs = recommendations(spark, *[("popularity", p, r, f"t{(p * r) % 19}") for p in range(30) for r in range(1, 18)])
    recs = recs.dropDuplicates(["pid", "track_id"])
    targets = spark.createDataFrame([(p, f"t{(p + j) % 19}") for p in range(30) for j in range(5)], TARGET)
    got = sorted(ranking_metrics(recs, targets, [1, 3, 10, 17], ["popularity"]).collect(), key=lambda r: r.k)
    assert all(0 <= v <= 1 for r in got for v in (r.recall, r.precision, r.ndcg))
    assert [r.recall for r in got] == sorted(r.recall for r in got)
    hits = hits_and_dcg(recs, targets, [1, 3, 10, 17])
    for r in got:
        total = sum(h.hit_count for h in hits.where(f"k = {r.k}").collect())
        assert r.precision == pytest.approx(total / r.k / 30)


def test_hits_keep_collections_without_a_hit(spark):
    recs = recommendations(spark, ("popularity", 1, 1, "a"), ("popularity", 1, 2, "b"), ("popularity", 2, 1, "z"))
    targets = spark.createDataFrame([(1, "b"), (2, "q")], TARGET)
    got = rows(hits_and_dcg(recs, targets, [1, 2]), "pid", "k", "hit_count", "dcg")
    assert [r[:3] for r in got] == [(1, 1, 0.0), (1, 2, 1.0), (2, 1, 0.0), (2, 2, 0.0)]
    assert [r[3] for r in got] == pytest.approx([0, 1 / log2(3), 0, 0], abs=1e-12)


def test_metrics_do_not_depend_on_partitions(spark):
    """Equal bit by bit: sums are of whole numbers."""
    recs = recommendations(spark, *[(b, p, r, f"t{(p * r) % 23}") for b in ("popularity", "cooccurrence") for p in range(97) for r in range(1, 18)])
    targets = spark.createDataFrame([(p, f"t{(p * 7 + j) % 23}") for p in range(97) for j in range(1 + p % 7)], TARGET)
    results = []
    for n in (1, 7, 50):
        shuffled = recs.repartition(n), targets.repartition(n)
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        results.append((rows(ranking_metrics(*shuffled, [1, 3, 10])), rows(hits_and_dcg(*shuffled, [1, 3, 10]))))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert results[0] == results[1] == results[2]


def test_metrics_are_the_plain_averages(spark):
    data = [("popularity", p, r, f"t{(p * r) % 23}") for p in range(31) for r in range(1, 12)]
    wanted = {p: {f"t{(p * 7 + j) % 23}" for j in range(1 + p % 7)} for p in range(31)}
    recs = recommendations(spark, *data).dropDuplicates(["pid", "track_id"])
    listed = {(r.pid, r.rank): r.track_id for r in recs.collect()}
    targets = spark.createDataFrame([(p, t) for p, ts in wanted.items() for t in ts], TARGET)
    for got in ranking_metrics(recs, targets, [3, 10], ["popularity"]).collect():
        recall = precision = ndcg = 0.0
        for p, items in wanted.items():
            ranks = [r for r in range(1, got.k + 1) if listed.get((p, r)) in items]
            recall += len(ranks) / len(items) / 31
            precision += len(ranks) / got.k / 31
            ndcg += sum(1 / log2(r + 1) for r in ranks) / sum(1 / log2(r + 1) for r in range(1, min(len(items), got.k) + 1)) / 31
        assert (got.recall, got.precision, got.ndcg) == pytest.approx((recall, precision, ndcg), abs=1e-11)


def test_ideal_dcg(spark):
    frame = spark.createDataFrame([(0, 5), (1, 5), (3, 10), (10, 3)], "t long, k int")
    got = {r.t: r.v for r in frame.withColumn("v", ideal_dcg("t", "k")).collect()}
    assert got[0] == 0 and got[1] == 1
    assert got[3] == pytest.approx(2.1309297535714578) and got[10] == pytest.approx(got[3])


def test_report_is_one_document(spark, tmp_path):
    recs = recommendations(spark, ("popularity", 1, 1, "a"))
    metrics = ranking_metrics(recs, spark.createDataFrame([(1, "a")], TARGET), [1, 10])
    path = tmp_path / "deeper" / "report.json"
    write_text(spark, str(path), report_json(metrics))
    content = {
        "baselines": {
            "cooccurrence": {f"{m}@{k}": 0.0 for m in ("NDCG", "Precision", "Recall") for k in (1, 10)},
            "popularity": {"NDCG@1": 1.0, "NDCG@10": 1.0, "Precision@1": 1.0, "Precision@10": 0.1, "Recall@1": 1.0, "Recall@10": 1.0},
        }
    }
    assert path.is_file() and path.read_text() == json.dumps(content, indent=2, sort_keys=True)
    assert {k: v.asDict() for k, v in spark.read.json(str(path), multiLine=True).first().baselines.asDict().items()} == content["baselines"]
    with pytest.raises(FileExistsError):
        write_text(spark, str(path), "other")
    write_text(spark, str(path), "other", overwrite=True)
    assert path.read_text() == "other"
    assert metrics_report(metrics).first().baselines == content["baselines"]
