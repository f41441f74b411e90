"""Collections with nested items -> flat collection, item and interaction tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructField, StructType

from basketry.functions.firsts import first_holders
from basketry.functions.text import clean_text, last_segment_id, source_slice_range
from basketry.sources.documents import COUNTERS

REFERENCES = ("track", "artist", "album")


def _references(item: str, names: bool) -> list[Column]:
    """URI, id and, on demand, name of the item, its artist and its album."""
    columns = []
    for entity in REFERENCES:
        uri = f"{item}.{entity}_uri"
        columns += [clean_text(uri).alias(f"{entity}_uri"), last_segment_id(uri).alias(f"{entity}_id")]
        if names:
            columns.append(clean_text(f"{item}.{entity}_name").alias(f"{entity}_name"))
    return columns


def flatten_collections(collections: DataFrame) -> DataFrame:
    """One row per collection with a pid: its header fields, source file and slice bounds."""
    start, end = source_slice_range("source_file")
    return collections.where(F.col("playlist.pid").isNotNull()).select(
        "playlist.pid",
        clean_text("playlist.name").alias("name"),
        F.col("playlist.collaborative").try_cast("boolean").alias("collaborative"),
        *[F.col(f"playlist.{counter}") for counter in COUNTERS],
        "source_file",
        start.alias("slice_start"),
        end.alias("slice_end"),
    )


def is_interaction(pid: Column, item: Column) -> Column:
    """An occurrence with a pid, a position and an item URI; never null."""
    return pid.isNotNull() & item["pos"].isNotNull() & clean_text(item["track_uri"]).isNotNull()


def flatten_interactions(collections: DataFrame) -> DataFrame:
    """One row per item occurrence. Occurrences without a pid, position or item URI are left out."""
    return (
        collections.where(F.col("playlist.pid").isNotNull())
        .select("playlist.pid", F.explode("playlist.tracks").alias("item"))
        .where(is_interaction(F.col("pid"), F.col("item")))
        .select(
            "pid",
            F.col("item.pos").cast("bigint").alias("pos"),
            *_references("item", names=False),
            F.col("item.duration_ms"),
        )
    )


def _or_last(part: Column) -> Column:
    """A pid or position; a missing one comes last."""
    return F.coalesce(part, F.lit((1 << 63) - 1))


def item_dimension(collections: DataFrame) -> DataFrame:
    """One row per item URI; each attribute is its first non-null value by (pid, pos), ties by value.

    A task sends only the occurrences that hold a first value among those it has at hand, with what they hold first: an
    item with a large share of all occurrences is a few rows of every portion. They are shuffled once, as they stand in
    the document; what is made of them is made where they meet.
    """
    raw = [f"{entity}_{part}" for entity in REFERENCES for part in ("uri", "name")] + ["duration_ms"]
    occurrences = (
        collections.select(F.col("playlist.pid").alias("pid"), F.explode("playlist.tracks").alias("item"))
        .select(
            clean_text("item.track_uri").alias("of"),
            _or_last(F.col("pid")).alias("seen_in"),
            _or_last(F.col("item.pos")).alias("seen_at"),
            *[F.col(f"item.{c}") for c in raw],
        )
        .where(F.col("of").isNotNull())
    )
    # The columns of an occurrence, and which of the attributes are made of each.
    made = {c.replace("_uri", "_id"): c for c in raw} | {c: c for c in raw if c != "track_uri"}
    attributes = [c for c in (*[f"{e}_{part}" for e in REFERENCES for part in ("uri", "id", "name")], "duration_ms") if c in made]
    derived = {
        a: last_segment_id(made[a]) if a.endswith("_id") else F.col(a) if a == "duration_ms" else clean_text(made[a]) for a in attributes
    }
    bits = {a: 1 << at for at, a in enumerate(attributes)}
    known = sum((F.when(derived[a].isNotNull(), bit).otherwise(0) for a, bit in bits.items()), start=F.lit(0))
    values = {c: sum(bit for a, bit in bits.items() if made[a] == c) for c in raw}
    judged = occurrences.withColumn("known", known)
    schema = StructType([StructField(f.name, f.dataType) for f in judged.schema])
    first = judged.mapInArrow(first_holders("of", ("seen_in", "seen_at"), "known", values), schema).drop("known").repartition("of")
    met = first.select("of", "seen_in", "seen_at", *[value.alias(a) for a, value in derived.items()])
    firsts = [F.min(F.when(F.col(a).isNotNull(), F.struct("seen_in", "seen_at", F.col(a).alias("value")))).alias(a) for a in attributes]
    return met.groupBy("of").agg(*firsts).select(F.col("of").alias("track_uri"), *[F.col(a)["value"].alias(a) for a in attributes])
