"""Irregular documents, read from files and from a stream."""

import json
import os

import pytest
from pyspark.sql import functions as F

from basketry.operators import flatten_collections, flatten_interactions, ingest_summary, item_dimension
from basketry.sources import collections_of, read_documents, scan_nested_json
from basketry.streaming import parse_documents
from tests.conftest import rows


def item(uri, pos, **more):
    return {"track_uri": uri, "pos": pos, **more}


PLAYLISTS = [
    {
        "pid": 1,
        "name": "  hi ",
        "collaborative": True,
        "num_tracks": 5,
        "tracks": [
            item("a:track:X", 0, artist_uri="a:artist:P", duration_ms=7),
            item("a:track:X", 1, track_name=" X song ", artist_uri="a:artist:Q"),
            item("a:track:Y", "7"),
            None,
            item("   ", 3),
            item(" x:y ", 4),
        ],
    },
    {"pid": 2, "name": "   ", "collaborative": "false", "tracks": []},
    None,
    {"pid": None, "name": "", "tracks": [item("a:track:Z", 0, track_name="z"), item("a:track:X", 0, album_name="late")]},
    {"pid": 3, "name": "\tabc  ", "tracks": [item("a:track:", 0), item("plain", None)]},
]


@pytest.fixture
def folder(tmp_path):
    deep = tmp_path / "mpd.slice.7-8" / "deeper"
    deep.mkdir(parents=True)
    (deep / "mpd.slice.0-999.json").write_text(json.dumps({"info": {"v": 1}, "playlists": PLAYLISTS}, indent=2))
    (tmp_path / "mpd.slice.1000-1999.json").write_text('{"playlists": [{"pid": 9, ')
    (tmp_path / "notes.json").write_text('{"playlists": [{"pid": 77}]}')
    (tmp_path / "mpd.slice.x-y.json").write_text('{"playlists": [{"pid": 78}]}')
    return str(tmp_path)


def test_collections(spark, folder):
    table = flatten_collections(scan_nested_json(spark, folder))
    assert rows(table, "pid", "name", "collaborative", "num_tracks", "slice_start", "slice_end") == [
        (1, "hi", True, 5, 0, 999),
        (2, None, False, None, 0, 999),
        (3, "\tabc", None, None, 0, 999),
    ]
    assert table.columns == [
        "pid", "name", "collaborative", "modified_at", "num_albums", "num_artists", "num_edits", "num_followers",
        "num_tracks", "duration_ms", "source_file", "slice_start", "slice_end",
    ]
    assert all(r.source_file.endswith("mpd.slice.0-999.json") for r in table.collect())


def test_interactions(spark, folder):
    table = flatten_interactions(scan_nested_json(spark, folder))
    assert rows(table, "pid", "pos", "track_uri", "track_id", "artist_id", "duration_ms") == [
        (1, 0, "a:track:X", "X", "P", 7),
        (1, 1, "a:track:X", "X", "Q", None),
        (1, 4, "x:y", "y ", None, None),
        (3, 0, "a:track:", None, None, None),
    ]


def test_items_are_stitched_from_first_known_values(spark, folder):
    table = item_dimension(scan_nested_json(spark, folder))
    assert rows(table, "track_uri", "track_id", "track_name", "artist_id", "album_name", "duration_ms") == [
        ("a:track:", None, None, None, None, None),
        ("a:track:X", "X", "X song", "P", "late", 7),
        ("a:track:Y", "Y", None, None, None, None),
        ("a:track:Z", "Z", "z", None, None, None),
        ("plain", "plain", None, None, None, None),
        ("x:y", "y ", None, None, None, None),
    ]


def test_first_known_value_does_not_depend_on_partitions(spark, folder):
    collections = scan_nested_json(spark, folder)
    expected = rows(item_dimension(collections))
    for n in (1, 7, 64):
        assert rows(item_dimension(collections.repartition(n))) == expected


def test_summary_counts_losses(spark, folder):
    summary = ingest_summary(read_documents(spark, folder)).first().asDict()
    assert summary == {
        "input_file_count": 2,
        "corrupt_files": 1,
        "playlists_read": 4,
        "items_read": 10,
        "dropped_interactions": 6,
    }


def test_broken_file_is_an_error_on_demand(spark, folder):
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        scan_nested_json(spark, folder, mode="FAILFAST").collect()


def test_missing_or_empty_folder(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        scan_nested_json(spark, str(tmp_path / "none"))
    (tmp_path / "other.json").write_text("{}")
    with pytest.raises(FileNotFoundError):
        scan_nested_json(spark, str(tmp_path))


def test_names_are_searched(spark, tmp_path):
    """The pattern may stand anywhere in the name; a folder where it stands in none is an error."""
    (tmp_path / "full_mpd.slice.0-999.json").write_text(json.dumps({"playlists": [{"pid": 1, "tracks": []}]}))
    (tmp_path / "mpd.slice.1-2.part.json").write_text(json.dumps({"playlists": [{"pid": 2, "tracks": []}]}))
    assert rows(flatten_collections(scan_nested_json(spark, str(tmp_path))), "pid", "slice_end") == [(1, 999), (2, 2)]
    other = tmp_path / "other"
    other.mkdir()
    (other / "mpd.slice.a-b.json").write_text("{}")
    with pytest.raises(FileNotFoundError):
        scan_nested_json(spark, str(other))


def test_large_positions(spark, tmp_path):
    tracks = [item("a:track:X", 3_000_000_000), item("a:track:Y", None)]
    (tmp_path / "mpd.slice.0-1.json").write_text(json.dumps({"playlists": [{"pid": 1, "tracks": tracks}]}))
    documents = read_documents(spark, str(tmp_path))
    assert rows(flatten_interactions(collections_of(documents)), "pos", "track_id") == [(3_000_000_000, "X")]
    assert ingest_summary(documents).first().dropped_interactions == 1


def test_documents_as_a_stream(spark, tmp_path):
    source = tmp_path / "in"
    os.mkdir(source)
    for name, playlists in (("a", PLAYLISTS), ("b", [{"pid": 5, "tracks": [item("a:track:N", 2)]}])):
        (source / f"{name}.txt").write_text(json.dumps({"playlists": playlists}))
    texts = spark.readStream.option("wholetext", True).text(str(source)).selectExpr(
        "value", "'mpd.slice.0-9.json' AS source_file"
    )
    flat = flatten_interactions(collections_of(parse_documents(texts)))
    query = flat.writeStream.format("memory").queryName("arrived").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert rows(spark.table("arrived"), "pid", "pos", "track_id") == [
        (1, 0, "X"), (1, 1, "X"), (1, 4, "y "), (3, 0, None), (5, 2, "N"),
    ]


def test_occurrences_travel_in_order_by_two_numbers(spark, tmp_path):
    """A decimal of both took more bytes in the shuffle. Places as far apart as numbers go keep their order."""
    far = 2**62
    lists = [(far, -far, "d"), (-far, far, "b"), (-far, -far, "a"), (-far, None, "c"), (None, -far, "e")]
    for n in range(1, len(lists) + 1):
        playlists = [{"pid": pid, "tracks": [item("a:track:X", pos, track_name=name)]} for pid, pos, name in lists[-n:]]
        (tmp_path / f"mpd.slice.{n}-{n}.json").write_text(json.dumps({"playlists": playlists}))
        found = item_dimension(scan_nested_json(spark, str(tmp_path)).where(F.col("source_file").contains(f"slice.{n}-")))
        assert "decimal" not in found._jdf.queryExecution().executedPlan().toString()
        assert found.first().track_name == min(p["tracks"][0]["track_name"] for p in playlists)
