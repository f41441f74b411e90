"""Chat formatting against a plain loop, with segments small enough to be crossed."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from basketry.llm.chat_format import chat_digests, format_chats, parse_chats
from tests.conftest import rows

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
BITS = ["<|im_end|>", "<|im_end|>\n", "<|im_start|>", "<|im_sep|>", "<|nl|>", "<", "|", "||", "<|", "<||", "a", "é", "𝄞", "\n", "\\", "$1", " "]


def ordered(data):
    found = {}
    for conv, turn, role, text in data:
        found.setdefault(conv, []).append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    return {c: [(r.decode(), t.decode()) for _, _, r, t in sorted(v)] for c, v in found.items()}


def plainly_formatted(turns):
    escaped = lambda s: s.replace("<|", "<||")
    text, before = "", None
    for i, (role, said) in enumerate(turns):
        if i and role == before:
            text += "<|im_sep|>" + escaped(said)
        else:
            text += ("<|im_end|>\n" if i else "") + "<|im_start|>" + escaped(role).replace("\n", "<|nl|>") + "\n" + escaped(said)
        before = role
    return text + "<|im_end|>\n"


def talk(seed):
    draw = random.Random(seed)
    said = lambda: None if draw.random() < 0.1 else "".join(draw.choice(BITS) for _ in range(draw.randint(0, 6)))
    return [
        (conv, None if draw.random() < 0.1 else draw.randint(0, 40), draw.choice(["user", "assistant", "assistant", "system", None, "", "a\nb<|x"]), said())
        for conv in (None, -1, 0, 1, 2, 2**60)
        for _ in range(draw.choice([1, 3, 10, 50]))
    ]


@pytest.mark.parametrize("segment", [1_000_000, 20_000, 1])
def test_texts_come_back(spark, segment):
    data = talk(1)
    formatted = format_chats(spark.createDataFrame(data, SCHEMA), segment=segment).cache()
    pieces = {}
    for r in formatted.orderBy("segment").collect():
        pieces[r.conv_id] = pieces.get(r.conv_id, "") + r.formatted
    expected = ordered(data)
    assert pieces == {c: plainly_formatted(turns) for c, turns in expected.items()}
    digests = {r.conv_id: r for r in chat_digests(formatted).collect()}
    assert set(digests) == set(expected)
    for conv, turns in expected.items():
        found, loss = digests[conv], "".join(t for r, t in turns if r == "assistant")
        assert found.n_turns == len(turns) and found.loss_chars == len(loss) and found.formatted_chars == len(pieces[conv])
        assert found.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert found.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert found.n_blocks == sum(i == 0 or turns[i][0] != turns[i - 1][0] for i in range(len(turns)))


def test_a_segment_is_bounded(spark):
    data = [(1, n, "user" if n % 3 else "assistant", "x" * 100) for n in range(500)]
    formatted = format_chats(spark.createDataFrame(data, SCHEMA), segment=50_000)
    sizes = [r.n for r in formatted.select(F.length("formatted").alias("n")).collect()]
    assert len(sizes) > 10 and max(sizes) < 50_000


def test_the_mask_covers_the_assistant_alone(spark):
    data = [(1, 0, "user", "q"), (1, 1, "assistant", "a<|b"), (1, 2, "assistant", ""), (1, 3, "user", "r")]
    parsed = parse_chats(format_chats(spark.createDataFrame(data, SCHEMA))).first()
    assert parsed.masked == ["a<|b", ""] and [tuple(t) for t in parsed.turns] == [r[2:] for r in data]


def test_long_texts_empty_tables_and_clashing_names(spark, clashing):
    long = "word <|im_end|> " * 200_000
    table = clashing(spark.createDataFrame([(1, 0, "assistant", long), (1, 1, "user", "x")], SCHEMA)).withColumns({n: F.lit(1) for n in ("segment", "formatted", "last")})
    assert rows(chat_digests(format_chats(table)), "loss_chars", "loss_sha256") == [(len(long), hashlib.sha256(long.encode()).hexdigest())]
    assert chat_digests(format_chats(table.where("conv_id = 2"))).count() == 0
