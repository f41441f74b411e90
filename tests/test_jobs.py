"""The three jobs in a row, through files."""

import json
import random
import subprocess
import sys
import threading
import time
from pathlib import Path

import pytest

from basketry.operators import SplitSpec
from basketry.plans import build_splits, ingest, run_baselines
from basketry.plans.jobs import ARTIFACTS, GOLD, SILVER
from basketry.sources import load_layer, write_tables
from basketry.sources.tables import READY, layer, save_table, scratch_root, table_path


@pytest.fixture(scope="module")
def layers(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("layers")
    bronze = root / "bronze"
    bronze.mkdir()
    rng = random.Random(7)
    for start in (0, 100):
        playlists = [
            {
                "pid": pid,
                "name": f"list {pid}",
                "num_tracks": 20,
                "tracks": [
                    {"track_uri": f"x:track:{rng.randint(0, 40)}", "track_name": "n", "pos": pos, "duration_ms": 5}
                    for pos in range(rng.randint(2, 20))
                ],
            }
            for pid in range(start, start + 100)
        ]
        (bronze / f"mpd.slice.{start}-{start + 99}.json").write_text(json.dumps({"playlists": playlists}))
    return {name: str(root / name) for name in ("bronze", "silver", "gold", "artifacts", "sampled")}


def test_jobs_in_a_row(spark, layers):
    summary = ingest(spark, layers["bronze"], layers["silver"]).first()
    assert (summary.input_file_count, summary.playlists_read, summary.dropped_interactions) == (2, 200, 0)
    silver = load_layer(spark, layers["silver"], SILVER)
    assert silver["playlists"].count() == 200 and silver["tracks"].count() == 41
    assert silver["playlist_tracks"].columns == [
        "pid", "pos", "track_uri", "track_id", "artist_uri", "artist_id", "album_uri", "album_id", "duration_ms",
    ]

    spec = SplitSpec(0.6, 0.2, 0.2)
    assert summary.tracks_path == layers["silver"] + "/tracks.parquet"
    counts = build_splits(spark, layers["silver"], layers["gold"], spec).first()
    gold = load_layer(spark, layers["gold"], GOLD)
    assert counts.input_path == layers["silver"] and counts.test_context_path == layers["gold"] + "/test_context.parquet"
    assert counts.train_playlists + counts.validation_playlists + counts.test_playlists == 200 and counts.eligible_eval_playlists == 200 - counts.train_playlists
    total = sum(gold[name].count() for name in GOLD[1:])
    assert total == silver["playlist_tracks"].count()

    metrics, run = run_baselines(spark, layers["gold"], layers["artifacts"], "3,10", full_data=True)
    artifacts = load_layer(spark, layers["artifacts"], ARTIFACTS)
    assert artifacts["validation_recommendations"].where("rank > 10").count() == 0
    assert {(r.baseline_name, r.k) for r in metrics.collect()} == {
        (b, k) for b in ("popularity", "cooccurrence") for k in (3, 10)
    }
    run = run.first()
    assert run.sampled_validation_playlists == counts.validation_playlists and run.k_values == [3, 10]
    assert run.metrics["popularity"]["NDCG@3"] == metrics.where("baseline_name = 'popularity' AND k = 3").first().ndcg
    assert run.metrics_path == layers["artifacts"] + "/validation_metrics.json"
    report = json.loads(Path(layers["artifacts"], "validation_metrics.json").read_text())
    assert list(report) == ["baselines"] and sorted(report["baselines"]) == ["cooccurrence", "popularity"]
    assert report["baselines"]["popularity"]["Recall@3"] == metrics.where("baseline_name = 'popularity' AND k = 3").first().recall
    assert not [f.name for layer in ("silver", "gold", "artifacts") for f in Path(layers[layer]).iterdir() if f.name.startswith("_")]

    # A second run may not overwrite, unless asked to; the sampled mode uses fewer collections.
    with pytest.raises(FileExistsError):
        run_baselines(spark, layers["gold"], layers["artifacts"])
    with pytest.raises(FileExistsError):
        build_splits(spark, layers["silver"], layers["gold"], spec)
    again = build_splits(spark, layers["silver"], layers["gold"], spec, overwrite=True, complete_headers=True).first()
    assert again == counts
    assert sum(t.count() for name, t in load_layer(spark, layers["gold"], GOLD).items() if name in GOLD[1:]) == total
    _, sampled = run_baselines(
        spark, layers["gold"], layers["sampled"], [5], train_sample_size=30, validation_sample_size=4
    )
    sampled = sampled.first()
    assert (sampled.full_data_mode, sampled.sampled_train_playlists, sampled.sampled_validation_playlists) == (False, 30, 4)


def test_jobs_leave_no_scratch(spark, layers, tmp_path):
    folder = tmp_path / "scratch"
    given = {"overwrite": True, "scratch_dir": str(folder)}
    ingest(spark, layers["bronze"], str(tmp_path / "silver"), **given)
    build_splits(spark, str(tmp_path / "silver"), str(tmp_path / "gold"), SplitSpec(0.6, 0.2, 0.2), **given)
    metrics, run = run_baselines(spark, str(tmp_path / "gold"), str(tmp_path / "out"), [5], **given)
    assert list(folder.iterdir()) == [] and metrics.count() == 2 and run.count() == 1


def test_scratch_needs_a_shared_folder_on_a_cluster(spark, monkeypatch):
    class Conf:
        def __init__(self, **values):
            self.values = values

        def get(self, key, default=None):
            return self.values.get(key.replace(".", "_"), default)

    class Session:
        def __init__(self, **values):
            self.conf = Conf(**values)

    for values in ({"spark_master": "local-cluster[2,1,1024]"}, {"spark_master": "spark://host:7077"}, {}):
        with pytest.raises(ValueError):
            scratch_root(Session(**values))
    assert scratch_root(Session(spark_master="yarn", spark_checkpoint_dir="hdfs://shared/")).startswith("hdfs://shared/basketry-")
    assert scratch_root(Session(spark_master="local[4]")).startswith("/")


def test_missing_tables_are_named(spark, layers, tmp_path):
    with pytest.raises(FileNotFoundError, match="validation_context"):
        load_layer(spark, str(tmp_path), ("train_playlist_tracks", "validation_context"))


def test_wrong_arguments_fail_before_any_job(spark, tmp_path):
    for ratios in ((0.9, 0.2, 0.1), (1.2, -0.1, -0.1)):
        with pytest.raises(ValueError):
            SplitSpec(*ratios)
    with pytest.raises(ValueError):
        run_baselines(spark, str(tmp_path), str(tmp_path), "0,5")


def _broken(spark):
    from pyspark.sql import functions as F

    return spark.range(5).select(F.when(F.col("id") < 9, F.raise_error(F.lit("no third table"))).alias("id"))


@pytest.mark.parametrize("overwrite", [False, True])
def test_a_failing_table_leaves_none(spark, tmp_path, overwrite):
    if overwrite:
        write_tables({n: spark.range(3) for n in ("one", "two", "three")}, str(tmp_path))
    with pytest.raises(Exception, match="no third table"):
        write_tables({"one": spark.range(7), "two": spark.range(7), "three": _broken(spark)}, str(tmp_path), overwrite)
    assert sorted(p.name for p in tmp_path.iterdir()) == (["one.parquet", "three.parquet", "two.parquet"] if overwrite else [])
    if overwrite:
        assert [t.count() for t in load_layer(spark, str(tmp_path), ("one", "two", "three")).values()] == [3, 3, 3]


def test_a_killed_write_leaves_none(spark, tmp_path):
    """One of three concurrent writes is cancelled while it runs."""
    from pyspark.sql import functions as F

    slow = spark.range(8).repartition(8).select(F.udf(lambda x: (time.sleep(20), x)[1], "bigint")("id").alias("id"))
    known = {j for j in spark.sparkContext.statusTracker().getActiveJobsIds()}
    failed = []

    def write():
        try:
            write_tables({"one": spark.range(3), "two": slow, "three": spark.range(3)}, str(tmp_path))
        except Exception as error:  # noqa: BLE001
            failed.append(error)

    thread = threading.Thread(target=write)
    thread.start()
    staged = lambda: [p.name for s in tmp_path.glob("_staged-*") for p in s.iterdir() if (p / "_SUCCESS").exists()]
    for _ in range(300):
        if {"one.parquet", "three.parquet"} <= set(staged()) and set(spark.sparkContext.statusTracker().getActiveJobsIds()) - known:
            break
        time.sleep(0.1)
    assert not list(tmp_path.glob("*.parquet"))
    spark.sparkContext.cancelAllJobs()
    thread.join(60)
    assert failed and list(tmp_path.iterdir()) == []


def test_an_interrupted_commit_is_finished_by_the_next_reader(spark, tmp_path):
    """A driver lost between two moves: the staging folder has its marker and the tables that were not moved."""
    write_tables({"one": spark.range(3), "two": spark.range(3)}, str(tmp_path))
    staged = tmp_path / "_staged-x"
    save_table(spark.range(9), str(staged), "two")
    (staged / READY).write_text("")
    save_table(spark.range(9), str(tmp_path), "one", overwrite=True)
    save_table(spark.range(1), str(tmp_path / "_staged-unfinished"), "one")
    tables = load_layer(spark, str(tmp_path), ("one", "two"))
    assert [t.count() for t in tables.values()] == [9, 9] and not staged.exists()


def test_a_layer_is_not_overwritten_unasked(spark, tmp_path):
    write_tables({"one": spark.range(3)}, str(tmp_path))
    with pytest.raises(FileExistsError):
        write_tables({"two": spark.range(3), "one": spark.range(4)}, str(tmp_path))
    assert [p.name for p in tmp_path.iterdir()] == ["one.parquet"]
    with layer(spark, str(tmp_path), ("one",), overwrite=True) as staged:
        save_table(spark.range(4), staged, "one")
        assert spark.read.parquet(table_path(str(tmp_path), "one")).count() == 3
    assert spark.read.parquet(table_path(str(tmp_path), "one")).count() == 4


def test_a_query_leaves_nothing_behind(tmp_path):
    """Scratch tables are there while the driver runs, as the result reads them, and gone after it."""
    code = f"""
from glob import glob
from pyspark.sql import SparkSession
import __spark_entry__ as entry
conf = {{"spark.checkpoint.dir": {str(tmp_path)!r}, "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2"}}
spark = SparkSession.builder.master("local[2]").config(map=conf).getOrCreate()
assert entry.queries()["item_popularity"](spark, "/root/testdata/sf0.001").count() > 0
assert glob({str(tmp_path)!r} + "/basketry-*")
spark.stop()
"""
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parent.parent, check=True, timeout=300)
    for _ in range(100):  # the JVM ends after the driver's Python
        if not list(tmp_path.glob("basketry-*")):
            break
        time.sleep(0.2)
    assert not list(tmp_path.glob("basketry-*"))


def test_tables_are_written_small(spark, tmp_path):
    """What a job writes and reads again is compressed with zstd."""
    found = save_table(spark.range(1000), str(tmp_path), "numbers")
    assert all(name.endswith(".zstd.parquet") for name in found.inputFiles()) and found.count() == 1000
