"""Text clean-up expressions shared by the flattening operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: how a document's file name carries the range of collections it holds.
SLICE_NAME = r"mpd\.slice\.(\d+)-(\d+)"


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def clean_text(value: Column | str) -> Column:
    """Strip leading and trailing spaces (spaces only, tabs stay); blank becomes null."""
    return F.nullif(F.trim(_column(value)), F.lit(""))


def last_segment_id(value: Column | str, separator: str = ":") -> Column:
    """What follows the last separator; nothing there means null. The value is not trimmed first."""
    return F.nullif(F.substring_index(_column(value), separator, -1), F.lit(""))


def source_slice_range(path: Column | str) -> tuple[Column, Column]:
    """First and last collection number in a file name; folders above the file are ignored."""
    pattern = SLICE_NAME + r"[^/]*$"
    return tuple(F.regexp_extract(_column(path), pattern, group).try_cast("int") for group in (1, 2))
