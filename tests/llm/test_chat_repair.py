"""Conversation repair against a search over whole edit strings."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from basketry.llm.chat_repair import damaged, repair_conversations, repair_report

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def plainly_damaged(data):
    for conv, turn, role, text in data:
        spoken = lambda v: " " if v is None else str(v)
        fault = zlib.crc32(f"{spoken(conv)}:{spoken(turn)}".encode()) % 20
        role, text = spoken(role), spoken(text)
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        role = "user" if fault == 4 else role
        yield from [(conv, turn, role, text)] * {0: 0, 3: 2}.get(fault, 1)


def cheapest(turns, faults):
    """Least cost, then least letters, and the repaired lines: whole strings in a queue."""
    queue, done = [(0, "", 0, "", ())], set()
    while True:
        cost, letters, at, roles, lines = heapq.heappop(queue)
        if (at, roles[-1:]) in done:
            continue
        done.add((at, roles[-1:]))
        if at == len(turns) and roles[-1:] in ("", "a"):
            return cost, letters, lines
        following = "a" if roles[-1:] == "u" else "u"
        name = {"u": "user", "a": "assistant"}[following]
        heapq.heappush(queue, (cost + 2, letters + "I", at, roles + following, (*lines, f"{name}:")))
        if at == len(turns):
            continue
        role, text = turns[at]
        heapq.heappush(queue, (cost + 3, letters + "D", at + 1, roles, lines))
        if faults[at] in ("blank", "duplicate"):
            continue
        extra = faults[at] == "truncated"
        heapq.heappush(queue, (cost + 2 + extra, letters + "R", at + 1, roles + following, (*lines, f"{name}:{text}")))
        if role[:1] == following or (role[:1] == "s" and not roles):
            heapq.heappush(queue, (cost + extra, letters + "K", at + 1, roles + role[0], (*lines, f"{role}:{text}")))


def expected(data):
    convs = {conv: [] for conv, *_ in data}
    for conv, turn, role, text in plainly_damaged(data):
        convs[conv].append((turn is not None, turn or 0, role.encode(), text.encode()))
    for conv, found in convs.items():
        found.sort()
        turns, seen, faults = [(r.decode(), t.decode()) for _, _, r, t in found], set(), []
        for turn in turns:
            said = turn[1].rstrip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not said else "duplicate" if turn in seen else "truncated" if said[-1] not in ".!?" else "")
            seen.add(turn)
        known = [t for there, t, _, _ in found if there]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        cost, letters, lines = cheapest(turns, faults)
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        yield conv, (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, letters, digest)


def talk(seed, convs=250):
    draw = random.Random(seed)
    return [
        (conv, None if draw.random() < 0.05 else draw.choice([turn, turn, 2 * turn]), draw.choice(["user", "assistant", "assistant", "user", "system", None, "", "ug", "x"]), draw.choice([None, "", "a. ", "b!\n", "c", "c?x", "hi.", "hi.", "é.", "\x0b."]))
        for conv in [None, *range(convs)]
        for turn in range(draw.choice([1, 1, 2, 3, 5, 8, 30]))
    ]


@pytest.mark.parametrize("seed, memory", [(1, 4_000_000), (2, 10)])
def test_repairs_are_the_cheapest_and_least(spark, seed, memory):
    data = talk(seed)
    turns = spark.createDataFrame(data, SCHEMA).repartition(5)
    found = repair_report(turns, repair_conversations(damaged(turns), memory=memory))
    assert {r[0]: tuple(r)[1:] for r in found.collect()} == dict(expected(data))


def test_a_giant_is_carried_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        draw = random.Random(3)
        data = [(1, n, draw.choice(["user", "assistant"]), f"{n}.") for n in range(3000)] + [(0, 1, "user", "a."), (2, 1, "user", "b.")]
        turns = spark.createDataFrame(data, SCHEMA)
        repaired = repair_conversations(turns, memory=1000).cache()
        found = {r.conv_id: (r["sum(cost)"], r["count(1)"]) for r in repaired.groupBy("conv_id").agg(F.sum("cost"), F.count(F.lit(1))).collect()}
        turn_list = [(r, t) for c, _, r, t in data if c == 1]
        cost, letters, lines = cheapest(turn_list, [""] * 3000)
        assert found[1] == (cost, len(letters))
        kept = repaired.where("conv_id = 1 AND edit <> 'D'").orderBy("step").collect()
        assert tuple(f"{r.role}:{r.text}" for r in kept) == lines
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_rows_tell_the_edits(spark):
    data = [(5, 0, "system", "s."), (5, 1, "assistant", "hello"), (5, 2, "user", " "), (5, 3, "assistant", "hello")]
    found = repair_conversations(spark.createDataFrame(data, SCHEMA)).orderBy("step").collect()
    assert [(r.edit, r.fault, r.role, r.text, r.cost) for r in found] == [
        ("K", None, "system", "s.", 0),
        ("I", None, "user", "", 2),
        ("K", "truncated", "assistant", "hello", 1),
        ("D", "blank", "user", " ", 3),
        ("D", "duplicate", "assistant", "hello", 3),
    ]


def test_long_texts_empty_tables_and_clashing_names(spark, clashing):
    long = "x" * 3_000_000 + "."
    table = clashing(spark.createDataFrame([(2**60, 2**60 + 1, "user", long), (2**60, None, "assistant", "a")], SCHEMA)).withColumns({n: F.lit(1) for n in ("fault", "conv", "step")})
    found = repair_conversations(table).orderBy("step").collect()
    assert [(r.conv_id, r.turn, len(r.text)) for r in found if r.edit != "I"] == [(2**60, None, 1), (2**60, 2**60 + 1, len(long))]
    nothing = table.where("conv_id = 1")
    assert repair_report(nothing, repair_conversations(nothing)).count() == 0
    gone = repair_report(table, repair_conversations(nothing)).first()
    assert tuple(gone) == (2**60, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
