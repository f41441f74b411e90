"""Nested JSON documents: one file is one object holding an array of collections, each an array of items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from basketry.functions.text import SLICE_NAME

CORRUPT = "_corrupt_record"

ITEM = StructType(
    [StructField(n, StringType()) for n in ("track_uri", "track_name", "artist_uri", "artist_name", "album_uri", "album_name")]
    + [StructField(n, LongType()) for n in ("duration_ms", "pos")]
)
COUNTERS = (
    "modified_at",
    "num_albums",
    "num_artists",
    "num_edits",
    "num_followers",
    "num_tracks",
    "duration_ms",
)
# "collaborative" is read as text: both true and "true" occur, and a boolean field would lose the latter.
COLLECTION = StructType(
    [StructField("pid", LongType()), StructField("name", StringType()), StructField("collaborative", StringType())]
    + [StructField(n, LongType()) for n in COUNTERS]
    + [StructField("tracks", ArrayType(ITEM))]
)
DOCUMENT = StructType([StructField("playlists", ArrayType(COLLECTION))])
WITH_CORRUPT = StructType(DOCUMENT.fields + [StructField(CORRUPT, StringType())])


def _unreadable(playlists: str, corrupt: str) -> Column:
    """Nothing could be parsed. A field of the wrong type alone is null and leaves the rest of the file."""
    return F.col(playlists).isNull() & F.col(corrupt).isNotNull()


def read_documents(
    spark: SparkSession,
    path: str,
    name_glob: str = "*mpd.slice.*-*.json",
    name_pattern: str = SLICE_NAME + r".*\.json$",
    mode: str = "PERMISSIVE",
) -> DataFrame:
    """One row per matching file at any depth below ``path``: ``source_file, playlists, unreadable``.

    A file matches if ``name_pattern`` is found in its name, wherever in it; ``name_glob`` only narrows the listing.
    A missing folder or a folder without a matching file is an error. A file that is not valid JSON keeps its
    row, marked ``unreadable``; ``mode="FAILFAST"`` makes it an error instead.
    """
    matches = F.col("_metadata.file_name").rlike(name_pattern)
    named = {"recursiveFileLookup": True, "pathGlobFilter": name_glob}
    # Without their content, files are only listed: one name answers whether there is any.
    if spark.read.format("binaryFile").options(**named).load(path).where(matches).select("path").isEmpty():
        raise FileNotFoundError(f"no file with {name_pattern} in its name under {path}")
    reader = (
        spark.read.schema(DOCUMENT if mode == "FAILFAST" else WITH_CORRUPT)
        .option("multiLine", True)
        .option("mode", mode)
        .options(**named)
    )
    files = reader.json(path)
    unreadable = F.lit(False) if mode == "FAILFAST" else _unreadable("playlists", CORRUPT)
    return files.where(matches).select(
        F.col("_metadata.file_path").alias("source_file"), "playlists", unreadable.alias("unreadable")
    )


def parse_documents(texts: DataFrame, text: str = "value", source_file: str = "source_file") -> DataFrame:
    """The rows of :func:`read_documents` for documents held in a text column."""
    parsed = F.from_json(text, WITH_CORRUPT, {"columnNameOfCorruptRecord": CORRUPT})
    return texts.select(F.col(source_file).alias("source_file"), parsed.alias("d")).select(
        "source_file", "d.playlists", _unreadable("d.playlists", f"d.{CORRUPT}").alias("unreadable")
    )


def collections_of(documents: DataFrame) -> DataFrame:
    """One row per collection: ``source_file, playlist``. Null collections are left out."""
    return documents.select("source_file", F.explode("playlists").alias("playlist")).where(
        F.col("playlist").isNotNull()
    )


def scan_nested_json(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """One row per collection in the documents below ``path``; options as in :func:`read_documents`."""
    return collections_of(read_documents(spark, path, **options))
