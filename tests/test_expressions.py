import pytest
import xxhash
from pyspark.sql import functions as F

from basketry.functions import clean_text, hash_score, last_segment_id, source_slice_range, validate_ks, validate_ratios


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first().x


@pytest.mark.parametrize(
    "text, cleaned", [("  hi ", "hi"), ("   ", None), ("", None), (None, None), ("\tabc  ", "\tabc"), (" x", " x")]
)
def test_clean_text(spark, text, cleaned):
    assert one(spark, clean_text(F.lit(text).cast("string"))) == cleaned


@pytest.mark.parametrize(
    "uri, segment", [("a:track:X", "X"), ("a:track:", None), ("plain", "plain"), (" x:y ", "y "), ("", None), (None, None)]
)
def test_last_segment_id(spark, uri, segment):
    assert one(spark, last_segment_id(F.lit(uri).cast("string"))) == segment


@pytest.mark.parametrize(
    "path, bounds",
    [
        ("file:/d/mpd.slice.1000-1999.json", (1000, 1999)),
        ("file:/mpd.slice.7-8/mpd.slice.0-9.part2.json", (0, 9)),
        ("file:/mpd.slice.7-8/other.json", (None, None)),
        ("mpd.slice.99999999999-1.json", (None, 1)),
    ],
)
def test_source_slice_range(spark, path, bounds):
    row = spark.range(1).select(*source_slice_range(F.lit(path))).first()
    assert tuple(row) == bounds


def chained_xxh64(*parts):
    """The hash of several strings, by a library of its own: each hash seeds the next."""
    value = 42
    for part in parts:
        value = xxhash.xxh64(part.encode(), seed=value).intdigest()
    return value - (1 << 64) if value >= 1 << 63 else value


PINNED = 110787328466360675


def test_hash_scores_are_pinned(spark):
    assert chained_xxh64("42", "7") == PINNED
    assert one(spark, F.xxhash64(F.lit("42"), F.lit("7"))) == PINNED
    assert one(spark, hash_score(42, F.lit(7))) == PINNED % 1_000_000
    assert one(spark, hash_score(42, F.lit("validation"), F.lit(7), hash_fn="md5")) == 901638


def test_float_modulus_rounds_the_hash_first(spark):
    exact, rounded = (one(spark, hash_score(42, F.lit(7), modulus=m)) for m in (1_000_000, 1_000_000.0))
    assert rounded == float(PINNED) % 1_000_000.0
    assert rounded != exact


def test_unknown_hash_is_refused():
    with pytest.raises(ValueError):
        hash_score(1, "pid", hash_fn="sha")


def test_ratios_must_sum_to_one():
    validate_ratios(0.9, 0.05, 0.05)
    with pytest.raises(ValueError):
        validate_ratios(0.9, 0.05, 0.06)


def test_ks():
    assert validate_ks("10, 50,,10,100") == [10, 50, 100]
    assert validate_ks([5, 1, 5]) == [1, 5]
    for wrong in ("", [], "0", [3, -1], ","):
        with pytest.raises(ValueError):
            validate_ks(wrong)
