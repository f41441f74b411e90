"""Chat formatting by Spark expressions: turns to one marked text with a loss mask, and back.

A conversation's turns are collected and sorted as structs, adjacent turns of one role are merged by an array
aggregation, and the pieces are concatenated. The template:

    <|im_start|>role⏎text<|im_sep|>text of the next turn of that role<|im_end|>⏎

Control strings inside texts and roles are escaped: ``<|`` becomes ``<||``, so no control string remains, and since every
``<|`` gets exactly one bar more, taking it away again gives the text back. A line break in a role becomes ``<|nl|>``.

Long conversations are not collected whole. Beyond ``SEGMENT`` characters (each turn counts as ``TURN`` more) their rows
are ranked by ranges and divided into segments of bounded size; a segment knows the roles before and behind it, so the
segments of a conversation, one after the other, are the same text that one piece would be.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from basketry.functions.ranking import range_rank
from basketry.sources.tables import save_table, scratch_root

START, SEPARATOR, END, BREAK = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n", "<|nl|>"
LOSS_ROLE = "assistant"
#: Characters of a segment, about; a longer text is a segment of its own.
SEGMENT = 1_000_000
#: Characters that a turn counts as, besides its text: bounds the turns of a segment.
TURN = 2000


def escaped(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("<||"))


def unescaped(text: Column) -> Column:
    return F.replace(text, F.lit("<||"), F.lit("<|"))


def _role_mark(role: Column) -> Column:
    """The start of a merged turn."""
    return F.concat(F.lit(START), F.replace(escaped(role), F.lit("\n"), F.lit(BREAK)), F.lit("\n"))


def _rows(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    return turns.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for n, c in (("role", role_col), ("text", text_col))),
    )


def _segmented(rows: DataFrame, segment: int, root: str) -> DataFrame | None:
    """``rows`` with the ``segment`` each belongs to, 0 in conversations that fit into one; None if all do."""
    weight = F.length("text").cast("bigint") + TURN
    sizes = rows.groupBy("conv_id").agg(F.sum(weight).alias("all"), F.max(weight).alias("most")).where(F.col("all") > segment)
    # A conversation's rows to a segment, so that none is larger than asked for, but of a single row.
    giants = sizes.select(F.col("conv_id").alias("giant"), F.greatest(F.lit(1), F.floor(F.lit(segment) / F.col("most"))).cast("bigint").alias("room"))
    giants = save_table(giants, root, "giants")
    if giants.isEmpty():
        return None
    # Spark broadcasts the written table of giants if it is as small as its setting asks, else it divides hot ids.
    same = F.col("conv_id").eqNullSafe(F.col("giant"))
    ordinary = rows.join(giants, same, "left_anti").withColumn("segment", F.lit(0).cast("bigint"))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    ranked = range_rank(rows.join(giants, same).drop("giant"), ["conv_id"], order, "place", root)
    return ordinary.unionByName(ranked.withColumn("segment", F.floor((F.col("place") - 1) / F.col("room"))).select(*rows.columns, "segment"))


def _merged(turns: Column) -> Column:
    """Sorted turn structs as blocks ``role, texts``: adjacent turns of one role are one block."""

    def add(blocks, turn):
        last, texts = F.element_at(blocks, -1), F.array(turn["text"])
        joined = F.concat(F.slice(blocks, F.lit(1), F.size(blocks) - 1), F.array(F.struct(turn["role"].alias("role"), F.concat(last["texts"], texts).alias("texts"))))
        same = (F.size(blocks) > 0) & (F.try_element_at(blocks, F.lit(-1))["role"] == turn["role"])
        return F.when(same, joined).otherwise(F.concat(blocks, F.array(F.struct(turn["role"].alias("role"), texts.alias("texts")))))

    none = F.array().cast("array<struct<role:string,texts:array<string>>>")
    return F.aggregate(turns, none, add)


def format_chats(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    loss_role: str = LOSS_ROLE, segment: int = SEGMENT, root: str | None = None,
) -> DataFrame:
    """``conv_id, segment, last, continues, formatted, loss``: the formatted conversations.

    ``loss``: ``(start, length)`` in code points of ``formatted`` for each text of ``loss_role``. ``continues``: the role
    that a segment goes on with, null if it begins with a turn of its own; conversations of one segment have segment 0
    alone, which is the ``last`` too. Turns are in ascending order, null turns first, ties by role and text. Null roles and texts count as empty,
    rows with a null conversation are one conversation, repeated rows are turns of their own. An empty table gives an
    empty result; other columns are not read.
    """
    root = root or scratch_root(turns.sparkSession)
    rows = _rows(turns, conv_col, turn_col, role_col, text_col)
    divided = _segmented(rows, segment, root)
    collected = F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns")
    if divided is None:
        blocks = rows.groupBy("conv_id").agg(collected).select("conv_id", _merged(F.col("turns")).alias("blocks"))
        nobody = F.lit(None).cast("string")
        blocks = blocks.withColumns({"segment": F.lit(0).cast("bigint"), "before": nobody, "behind": nobody, "last": F.lit(True)})
    else:
        blocks = divided.groupBy("conv_id", "segment").agg(collected).select("conv_id", "segment", _merged(F.col("turns")).alias("blocks"))
        blocks = save_table(blocks, root, "blocks")
        # The roles at the ends of the neighbours: a row for each segment.
        ends = blocks.select("conv_id", "segment", F.element_at("blocks", 1)["role"].alias("first"), F.element_at("blocks", -1)["role"].alias("final"))
        beside = Window.partitionBy("conv_id").orderBy("segment")
        ends = ends.select(F.col("conv_id").alias("of"), F.col("segment").alias("at"), F.lag("final").over(beside).alias("before"), F.lead("first").over(beside).alias("behind"))
        blocks = blocks.join(ends, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("segment") == F.col("at")))
        blocks = blocks.withColumn("last", F.col("behind").isNull())
    return _written(blocks, loss_role).select("conv_id", "segment", "last", "continues", "formatted", "loss")


def _written(blocks: DataFrame, loss_role: str) -> DataFrame:
    """The blocks of each segment as text, between the roles ``before`` and ``behind`` it."""
    goes_on = F.col("before") == F.element_at("blocks", 1)["role"]
    stays_open = F.col("behind") == F.element_at("blocks", -1)["role"]

    def pieces(block, at):
        opened = F.coalesce(goes_on, F.lit(False)) & (at == 0)
        closed = ~(F.coalesce(stays_open, F.lit(False)) & (at == F.size("blocks") - 1))

        def piece(text, i):
            mark = F.when(i > 0, F.lit(SEPARATOR)).when(opened, F.lit(SEPARATOR)).otherwise(_role_mark(block["role"]))
            end = F.when((i == F.size(block["texts"]) - 1) & closed, F.lit(END)).otherwise(F.lit(""))
            return F.struct(mark.alias("mark"), escaped(text).alias("text"), end.alias("end"), (block["role"] == loss_role).alias("loss"))

        return F.transform(block["texts"], piece)

    marked = blocks.withColumn("pieces", F.flatten(F.transform("blocks", pieces)))

    def place(state, piece):
        start = state["at"] + F.length(piece["mark"])
        length = F.length(piece["text"])
        spans = F.when(piece["loss"], F.concat(state["loss"], F.array(F.struct(start.alias("start"), length.alias("length"))))).otherwise(state["loss"])
        return F.struct((start + length + F.length(piece["end"])).alias("at"), spans.alias("loss"))

    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("loss"))
    return marked.select(
        "*",
        F.when(goes_on, F.col("before")).alias("continues"),
        F.array_join(F.transform("pieces", lambda p: F.concat(p["mark"], p["text"], p["end"])), "").alias("formatted"),
        F.aggregate("pieces", none, place, lambda s: s["loss"]).alias("loss"),
    )


def parse_chats(formatted: DataFrame) -> DataFrame:
    """``conv_id, segment, last, turns, masked, formatted_chars, n_blocks``: what :func:`format_chats` wrote, read back.

    ``turns``: ``(role, text)`` in order, merged turns apart again. ``masked``: the texts under the loss mask.
    ``n_blocks``: merged turns that begin in the segment.
    """
    opened = F.col("continues").isNotNull()
    text = F.when(opened, F.concat(_role_mark(F.col("continues")), F.substr("formatted", F.lit(len(SEPARATOR) + 1)))).otherwise(F.col("formatted"))
    parts = F.split(text, r"<\|im_start\|>", -1)
    blocks = F.slice(parts, F.lit(2), F.size(parts))  # before the first mark stands nothing

    def turns(block):
        at = F.instr(block, "\n")
        role = unescaped(F.replace(F.substr(block, F.lit(1), at - 1), F.lit(BREAK), F.lit("\n")))
        texts = F.split(F.replace(F.substr(block, at + 1), F.lit(END), F.lit("")), r"<\|im_sep\|>", -1)
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescaped(t).alias("text")))

    return formatted.select(
        "conv_id",
        "segment",
        "last",
        F.flatten(F.transform(blocks, turns)).alias("turns"),
        F.transform("loss", lambda s: unescaped(F.substr("formatted", s["start"] + 1, s["length"]))).alias("masked"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
        (F.size(blocks) - opened.cast("int")).cast("bigint").alias("n_blocks"),
    )


COUNTS = ("n_turns", "loss_chars", "formatted_chars", "n_blocks")


def _folded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Digests of conversations of several segments, which come in order: what is held is the hash so far."""
    counts, turns, loss = dict.fromkeys(COUNTS, 0), hashlib.sha256(), hashlib.sha256()
    for frame in frames:
        ended = []
        for row in frame.itertuples(index=False):
            turns.update(row.turns.encode("utf-8", "surrogatepass"))
            loss.update(row.masked.encode("utf-8", "surrogatepass"))
            counts = {n: counts[n] + getattr(row, n) for n in COUNTS}
            if row.last:
                ended.append({"conv": row.conv, "turns_sha256": turns.hexdigest(), "loss_sha256": loss.hexdigest(), **counts})
                counts, turns, loss = dict.fromkeys(COUNTS, 0), hashlib.sha256(), hashlib.sha256()
        if ended:
            yield pd.DataFrame(ended)


def chat_digests(formatted: DataFrame) -> DataFrame:
    """One row per conversation: ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_blocks``.

    All are of the texts read back. Digests of conversations of one segment are Spark expressions; the segments of
    longer ones meet in order and are hashed one after the other.
    """
    texts = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    read = parse_chats(formatted).select(
        "conv_id", "segment", "last", F.size("turns").cast("bigint").alias("n_turns"), F.array_join(texts, "").alias("turns"),
        F.array_join("masked", "").alias("masked"), "formatted_chars", "n_blocks",
    ).withColumn("loss_chars", F.length("masked").cast("bigint"))
    alone = (F.col("segment") == 0) & F.col("last")
    order = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_blocks"]
    short = read.where(alone).withColumns({f"{n}_sha256": F.sha2(F.col(c).cast("binary"), 256) for n, c in (("turns", "turns"), ("loss", "masked"))})
    kind = formatted.schema["conv_id"].dataType.simpleString()
    long = read.where(~alone).repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    # Ids go through pandas as text, which keeps nulls and large numbers.
    long = long.select(F.col("conv_id").cast("string").alias("conv"), "last", "turns", "masked", *COUNTS)
    long = long.mapInPandas(_folded, "conv string, turns_sha256 string, loss_sha256 string, " + ", ".join(f"{n} bigint" for n in COUNTS))
    return short.select(*order).unionByName(long.withColumn("conv_id", F.col("conv").cast(kind)).select(*order))
