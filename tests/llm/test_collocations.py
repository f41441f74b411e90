"""Collocation mining and its automata against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from basketry.llm import collocations
from basketry.llm.collocations import CountTransducer, best_collocations, mine_collocations, word_blocks

LOWER = {c: c + 32 for c in range(65, 91)}
VOCABULARY = ["the", "a", "New", "york", "City", "é", "É", "x\x01y", "\x01", "zz", "𝄞", "b\xa0c", *(f"w{i}" for i in range(30))]


def pieces(text):
    for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
        yield [w for w in re.split("[ \t]+", piece) if w]


def expected(docs, floor=10, cover=50):
    counts, n = {}, Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for words in pieces(text):
            n[lang] += len(words)
            for k in (1, 2, 3):
                counts.setdefault(lang, Counter()).update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    for lang, count in counts.items():
        found = {p: a for p, a in count.items() if len(p) > 1 and a >= floor}
        inner = {q for p, a in found.items() if len(p) == 3 for q in (p[:2], p[1:]) if 100 * a >= cover * found[q]}
        for p, a in found.items():
            if p not in inner:
                score, _, left, right = min((10**6 * a * a // (count[p[:k]] * count[p[k:]]), k, count[p[:k]], count[p[k:]]) for k in range(1, len(p)))
                yield lang, " ".join(p), len(p), a, left, right, n[lang], score


def texts(seed, many=300):
    draw = random.Random(seed)
    gap = lambda: draw.choice([" ", " ", " ", "  ", "\t", ". ", ", ", "\n"])
    docs = [
        (draw.choice(["en", "en", "en", "fr", None, "", "und"]), None if draw.random() < 0.05 else "".join(draw.choice(VOCABULARY) + gap() for _ in range(draw.randint(0, 120))))
        for _ in range(many)
    ]
    return [*docs, *[("en", "New York City the x. " * 50)] * 3]


@pytest.mark.parametrize("floor, cover, shard, ngrams", [(10, 50, 2_000_000, 300_000), (2, 50, 2000, 200), (3, 80, 1, 7), (2, 100, 2_000_000, 50)])
def test_phrases(spark, monkeypatch, floor, cover, shard, ngrams):
    docs = texts(floor)
    table = spark.createDataFrame(docs, "lang string, text string").repartition(3)
    found = mine_collocations(table, floor, cover, shard_words=shard, range_ngrams=ngrams)
    assert sorted(tuple(r) for r in found.collect()) == sorted(expected(docs, floor, cover))
    if floor == 2:
        ranked = best_collocations(found, 3).where("lang = 'en'").orderBy("rank").collect()
        best = sorted((x for x in expected(docs, floor, cover) if x[0] == "en"), key=lambda x: (-x[7], -x[3], x[1].encode()))[:3]
        assert [(r.rank, r.phrase) for r in ranked] == [(i, x[1]) for i, x in enumerate(best, 1)]


def test_ranges_are_cut(spark):
    draw = random.Random(9)
    docs = [("en", " ".join(f"w{int(40 * draw.random() ** 2)}" for _ in range(3000))) for _ in range(6)]
    table = spark.createDataFrame(docs, "lang string, text string")
    from basketry.sources.tables import scratch_root

    collocations._SAMPLE_EVERY, before = 50, collocations._SAMPLE_EVERY
    try:
        _, counts, cuts = collocations.phrase_counts(table, scratch_root(spark), 2, 5000, 400)
        machines = [CountTransducer.load(bytes(r.machine)) for r in counts.collect()]
    finally:
        collocations._SAMPLE_EVERY = before
    assert len(machines) > 4 and len(cuts.value["en"]) > 4
    together = CountTransducer.union(machines)
    keys, weights = together.sequences()
    base = len(together.labels) + 1
    got = {tuple(collocations._words(together.labels, k, base).split(b" ")): w for k, w in zip(keys.tolist(), weights.tolist(), strict=True)}
    count = Counter()
    for _, text in docs:
        words = text.encode().split()
        for k in (1, 2, 3):
            count.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    assert got == {p: a for p, a in count.items() if a >= 2}


def some_sequences(seed, labels, n):
    draw = random.Random(seed)
    return {tuple(draw.choice(labels) for _ in range(draw.randint(1, 3))): draw.randint(1, 3) for _ in range(n)}


def machine_of(counts):
    labels = sorted({w for p in counts for w in p})
    number = {w: i for i, w in enumerate(labels, 1)}
    base = len(labels) + 1
    packed = {p: sum(number[w] * base ** (2 - i) for i, w in enumerate(p)) for p in counts}
    order = sorted(counts, key=packed.get)
    return CountTransducer.build(labels, np.array([packed[p] for p in order], dtype=np.int64), np.array([counts[p] for p in order], dtype=np.int64))


def counts_of(machine):
    keys, weights = machine.sequences()
    base = len(machine.labels) + 1
    return {tuple(collocations._words(machine.labels, k, base).split(b" ")): w for k, w in zip(keys.tolist(), weights.tolist(), strict=True)}


@pytest.mark.parametrize("n", [0, 1, 30, 400])
def test_automata(n):
    labels = [b"a", b"b", b"bb", b"\x01", b"\xc3\xa9", b"z"]
    one, two = some_sequences(n, labels, n), some_sequences(n + 1, labels[:4], n)
    first, second = machine_of(one), machine_of(two)
    assert counts_of(CountTransducer.load(first.dump())) == one
    assert counts_of(CountTransducer.union([first, second, first])) == dict(Counter(one) + Counter(two) + Counter(one))
    outputs = {p: i for i, p in enumerate(sorted(two), 1)}
    numbers, weights = first.compose(machine_of(outputs))
    assert dict(zip(numbers.tolist(), weights.tolist(), strict=True)) == {i: one[p] for p, i in outputs.items() if p in one}


def test_equal_continuations_are_one_state():
    counts = {(a, b, c): 1 for a in (b"a", b"b", b"c") for b in (b"d", b"e") for c in (b"f", b"g")}
    machine = machine_of(counts)
    # One state after the first word, one after the second: 3 + 2 + 2 arcs.
    assert [len(t[1]) for t in machine.tables] == [3, 2, 2] and counts_of(machine) == counts


def test_blocks_of_long_texts(monkeypatch):
    text = "The one, two  three\tfour.five\x0bsix 7\xa08 " * 50
    monkeypatch.setattr(collocations, "_TEXT_CHARS", 7)
    blocks = list(word_blocks(text))
    assert len(blocks) > 20
    joined = b" ".join(w for block in blocks for w in block).split(b"\xff")
    assert [p.split() for p in joined if p.split()] == [[w.encode() for w in p] for p in pieces(text) if p]


def test_empty_tables_and_clashing_names(spark, documents, clashing):
    table = clashing(documents(*[(i, "very big words here " * 3) for i in range(10)], (None, None), (99, ""))).withColumnsRenamed({"n": "l"})
    found = mine_collocations(table).collect()
    assert {r.phrase for r in found} and all(r.n == 120 for r in found)
    assert mine_collocations(table.where("doc_id = 5000")).count() == 0
