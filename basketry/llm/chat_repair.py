"""Conversation repair: the cheapest edits that make the roles ``(s?(ua)+)?``, found in one pass over sorted rows.

Rows are dealt by conversation and sorted by turn; a streaming pass carries a dynamic programme over four states (nothing
yet, after system, after user, after assistant) from Arrow batch to Arrow batch. Each row may be kept, get another
role, or be deleted; empty turns may be inserted anywhere. Per row four bytes of backpointers are put aside, with the
row itself; both go to a temporary file of the task once a conversation is long, so memory holds neither.

Of equally cheap repairs the one whose letters (D, I, K, R) come first is taken. From a state a letter leads to one
state only, so the letters tell the whole repair. Partial repairs that end with a row's letter are never the beginning
of one another, so it is enough to carry the order of the four.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from tempfile import SpooledTemporaryFile

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

SPACES = " \t\n\x0b\x0c\r"
ENDINGS = (".", "!", "?")
KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2
TRUNCATED = 1
#: Bytes of one conversation's rows, and of its backpointers, that a task holds before it writes them to its own file.
MEMORY = 4_000_000
#: Rows and characters of a result batch.
BATCH_ROWS, BATCH_CHARS = 5000, 4_000_000

EMPTY, SYSTEM, USER, ASSISTANT = range(4)
_INITIALS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
# The state after an inserted or re-roled turn, and its role.
_NEXT = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
_LETTERS = "DIKR"
_ENDS = (EMPTY, ASSISTANT)


def damaged(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with faults put in by the checksum of ``conv_id:turn``; nulls are one space in texts.

    Of 20 remainders 0 drops a row, 1 empties its text, 2 takes its ``.``, ``!`` and ``?``, 3 repeats it, 4 makes its
    role user.
    """
    spoken = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    fault = F.crc32(F.concat_ws(":", *spoken[:2]).cast("binary")) % 20
    role = F.when(fault == 4, F.lit("user")).otherwise(spoken[2])
    text = F.when(fault == 1, F.lit("")).when(fault == 2, F.translate(spoken[3], ".!?", "")).otherwise(spoken[3])
    copies = F.array_repeat(F.lit(1), F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1))
    return turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def _steps(kind: tuple[int, bool, bool], costs: tuple, ranks: tuple) -> tuple[tuple, tuple, bytes]:
    """One row more: costs and order of the four states after it, and how each is reached (from, inserts, letter)."""
    start, gone, cut = kind
    best: list = [None] * 4
    for p in range(4):
        if costs[p] is None:
            continue
        at, cost = p, costs[p]
        for inserts in range(3):
            # An insert and another: as much as any gap between roles asks for.
            ways = [("D", at, DELETE)]
            if not gone:
                if (start == SYSTEM and at == EMPTY) or (start == USER and at != USER) or (start == ASSISTANT and at == USER):
                    ways.append(("K", start, KEEP + cut * TRUNCATED))
                ways.append(("R", _NEXT[at], REROLE + cut * TRUNCATED))
            for letter, to, price in ways:
                found = (cost + price, ranks[p], "I" * inserts + letter, p)
                if best[to] is None or found < best[to]:
                    best[to] = found
            at, cost = _NEXT[at], cost + INSERT
    order = sorted(b[1:3] for b in best if b)
    pointers = bytes(0 if b is None else b[3] | (len(b[2]) - 1) << 2 | _LETTERS.index(b[2][-1]) << 4 for b in best)
    return tuple(b and b[0] for b in best), tuple(b and order.index(b[1:3]) for b in best), pointers


class _Conversation:
    """The rows so far, the programme's state after them, and the way back."""

    #: Steps by kind of row and costs above the least: few, as costs never differ by much.
    known: dict = {}

    def __init__(self, conv: int | None, memory: int) -> None:
        self.conv, self.n = conv, 0
        self.rows, self.pointers = SpooledTemporaryFile(memory), SpooledTemporaryFile(memory)
        self.memory = memory
        self.costs, self.ranks = (0, None, None, None), (0, None, None, None)
        self.before: int | None = None

    def add(self, turn: int | None, role: str, text: str, fault: str | None) -> None:
        start = _INITIALS.get(role[:1], EMPTY)
        kind = (start, fault in ("blank", "duplicate"), fault == "truncated")
        pair = (self.before, start)
        illegal = self.n > 0 and pair not in ((SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER))
        self.before = start
        least = min(c for c in self.costs if c is not None)
        key = (kind, tuple(c if c is None else c - least for c in self.costs), self.ranks)
        if key not in self.known:
            self.known[key] = _steps(*key)
        costs, self.ranks, pointers = self.known[key]
        self.costs = tuple(c if c is None else c + least for c in costs)
        self.pointers.write(pointers)
        pickle.dump((turn, role, text, fault, illegal, start), self.rows)
        self.n += 1

    def _way(self) -> tuple[SpooledTemporaryFile, int]:
        """One byte for each row, inserts before it and its letter, and the inserts after the last row."""
        ends = []
        for p in range(4):
            if self.costs[p] is None:
                continue
            at, cost = p, self.costs[p]
            for inserts in range(3):
                if at in _ENDS:
                    ends.append((cost, self.ranks[p], "I" * inserts, p))
                at, cost = _NEXT[at], cost + INSERT
        _, _, tail, state = min(ends)
        chosen = SpooledTemporaryFile(self.memory)
        chosen.write(b"")
        step = 1 << 16
        for high in range(self.n, 0, -step):
            low = max(0, high - step)
            self.pointers.seek(4 * low)
            block = self.pointers.read(4 * (high - low))
            ways = bytearray(high - low)
            for i in range(high - low - 1, -1, -1):
                way = block[4 * i + state]
                ways[i] = way >> 2
                state = way & 3
            chosen.seek(low)
            chosen.write(ways)
        chosen.seek(0)
        return chosen, len(tail)

    def edits(self) -> Iterator[tuple]:
        """``conv, step, edit, fault, illegal, turn, role, text, cost`` in order."""
        chosen, tail = self._way()
        self.rows.seek(0)
        state, step = EMPTY, 0
        for low in range(0, self.n, 1 << 16):
            for way in chosen.read(min(1 << 16, self.n - low)):
                for _ in range(way & 3):
                    state = _NEXT[state]
                    yield self.conv, step, "I", None, False, None, ROLES[state], "", INSERT
                    step += 1
                turn, role, text, fault, illegal, start = pickle.load(self.rows)
                letter = _LETTERS[way >> 2]
                extra = TRUNCATED if fault == "truncated" else 0
                if letter == "D":
                    cost = DELETE
                elif letter == "K":
                    state, cost = start, KEEP + extra
                else:
                    state, cost = _NEXT[state], REROLE + extra
                    role = ROLES[state]
                yield self.conv, step, letter, fault, illegal, turn, role, text, cost
                step += 1
        for _ in range(tail):
            state = _NEXT[state]
            yield self.conv, step, "I", None, False, None, ROLES[state], "", INSERT
            step += 1
        for file in (chosen, self.rows, self.pointers):
            file.close()


_EDITS = ["conv_id", "step", "edit", "fault", "illegal", "turn", "role", "text", "cost"]


def _frame(rows: list[tuple], names: list[str], whole: tuple[str, ...]) -> pd.DataFrame:
    """Rows as a frame; ``whole`` columns are integers that may be null, which pandas would make floating."""
    columns = dict(zip(names, zip(*rows, strict=True), strict=True))
    return pd.DataFrame({n: pd.array(list(c), dtype="Int64") if n in whole else list(c) for n, c in columns.items()})


def _known(values, nulls) -> list:
    return [None if gone else v for v, gone in zip(values.tolist(), nulls.tolist(), strict=True)]


def _repaired(memory: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: _Conversation | None = None
        ready: list[tuple] = []
        chars = 0

        def finished() -> Iterator[pd.DataFrame]:
            nonlocal ready, chars
            for edit in now.edits():
                ready.append(edit)
                chars += len(edit[7])
                if len(ready) >= BATCH_ROWS or chars >= BATCH_CHARS:
                    yield _frame(ready, _EDITS, ("conv_id", "turn"))
                    ready, chars = [], 0

        for frame in frames:
            convs, turns = _known(frame["conv"], frame["conv_null"]), _known(frame["turn"], frame["turn_null"])
            for conv, turn, role, text, fault in zip(convs, turns, frame["role"], frame["text"], frame["fault"], strict=True):
                if now is None or now.conv != conv:
                    if now is not None:
                        yield from finished()
                    now = _Conversation(conv, memory)
                now.add(turn, role, text, fault or None)
        if now is not None:
            yield from finished()
        if ready:
            yield _frame(ready, _EDITS, ("conv_id", "turn"))

    return run


def repair_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", memory: int = MEMORY) -> DataFrame:
    """``conv_id, step, edit, fault, illegal, turn, role, text, cost``: a row for each edit, with the repaired turn.

    ``edit`` is K(eep), R(erole), D(elete) or I(nsert); a deleted row shows what it was, all others what the repaired
    conversation says. ``fault`` is the first that holds: blank, duplicate (role and text stand in an earlier row),
    truncated (the last character that is no space is none of ``.!?``), or null. ``illegal``: the initials of the roles
    of a row and the one before it are none of su, ua, au. The rows of a conversation follow each other in one
    partition, in order.

    Conversation and turn are bigint. Rows stand by turn, null turns first, ties by role and text. Null roles and texts
    count as one space; rows with a null conversation are one conversation; repeated rows are duplicates. An empty table
    gives an empty result; other columns are not read.
    """
    rows = turns.select(
        F.col(conv_col).cast("bigint").alias("conv_id"),
        F.col(turn_col).cast("bigint").alias("turn"),
        *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(n) for n, c in (("role", role_col), ("text", text_col))),
    )
    # Both sorts happen where the shuffle by conversation has put the rows.
    again = Window.partitionBy("conv_id", "role", "text").orderBy("turn")
    spoken = F.rtrim("text", F.lit(SPACES))
    fault = (
        F.when(spoken == "", "blank")
        .when(F.row_number().over(again) > 1, "duplicate")
        .when(~F.right(spoken, F.lit(1)).isin(*ENDINGS), "truncated")
        .otherwise("")
    )
    order = ("conv_id", "turn", "role", "text")
    placed = rows.repartition("conv_id").withColumn("fault", fault).sortWithinPartitions(*order)
    # Nulls beside numbers would make them floating in pandas.
    nulls = {f"{n}_null": F.col(c).isNull() for n, c in (("conv", "conv_id"), ("turn", "turn"))}
    plain = placed.select(F.coalesce("conv_id", F.lit(0)).alias("conv"), *(v.alias(k) for k, v in nulls.items()), F.coalesce("turn", F.lit(0)).alias("turn"), "role", "text", "fault")
    schema = "conv_id bigint, step bigint, edit string, fault string, illegal boolean, turn bigint, role string, text string, cost bigint"
    return plain.mapInPandas(_repaired(memory), schema)


_DIGESTS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


class _Digest:
    def __init__(self, conv: int | None) -> None:
        self.conv, self.faults, self.illegal, self.cost = conv, dict.fromkeys(("blank", "duplicate", "truncated"), 0), 0, 0
        self.first = self.last = None
        self.turns, self.audit, self.text, self.said = 0, bytearray(), hashlib.sha256(), False

    def add(self, edit: str, fault: str | None, illegal: bool, turn: int | None, role: str, text: str, cost: int) -> None:
        self.audit += edit.encode()
        self.cost += cost
        self.illegal += bool(illegal)
        if fault in self.faults:
            self.faults[fault] += 1
        if turn is not None and turn != self.last:  # turns ascend
            self.first = turn if self.first is None else self.first
            self.last = turn
            self.turns += 1
        if edit != "D":
            self.text.update((("\n" if self.said else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
            self.said = True

    def row(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return self.conv, gaps, *self.faults.values(), self.illegal, self.cost, self.audit.decode(), self.text.hexdigest()


def _digested(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    now: _Digest | None = None
    for frame in frames:
        ready = []
        convs, turns = _known(frame["conv"], frame["conv_null"]), _known(frame["turn"], frame["turn_null"])
        columns = (frame[c] for c in ("edit", "fault", "illegal"))
        for conv, edit, fault, illegal, turn, role, text, cost in zip(convs, *columns, turns, frame["role"], frame["text"], frame["cost"], strict=True):
            if now is None or now.conv != conv:
                if now is not None:
                    ready.append(now.row())
                now = _Digest(conv)
            now.add(edit, fault, illegal, turn, role, text, cost)
        if ready:
            yield _frame(ready, _DIGESTS, ("conv_id",))
    if now is not None:
        yield _frame([now.row()], _DIGESTS, ("conv_id",))


def repair_digests(repaired: DataFrame) -> DataFrame:
    """One row per conversation of :func:`repair_conversations`, whose rows are taken where they lie."""
    nulls = [F.col(c).isNull().alias(f"{n}_null") for n, c in (("conv", "conv_id"), ("turn", "turn"))]
    plain = repaired.select(F.coalesce("conv_id", F.lit(0)).alias("conv"), *nulls, "edit", "fault", "illegal", F.coalesce("turn", F.lit(0)).alias("turn"), "role", "text", "cost")
    kinds = {"audit": "string", "repaired_sha256": "string"}
    return plain.mapInPandas(_digested, ", ".join(f"{n} {kinds.get(n, 'bigint')}" for n in _DIGESTS))


def repair_report(turns: DataFrame, repaired: DataFrame) -> DataFrame:
    """The digests of every conversation of ``turns``; one that has no row in ``repaired`` has zeros and an empty repair."""
    convs = turns.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct()
    found = repair_digests(repaired).withColumnRenamed("conv_id", "of")
    numbers = [F.coalesce(c, F.lit(0)).alias(c) for c in _DIGESTS[1:7]]
    empty = hashlib.sha256(b"").hexdigest()
    return convs.join(found, F.col("conv_id").eqNullSafe(F.col("of")), "left").select(
        "conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256")
    )
