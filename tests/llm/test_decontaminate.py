from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest

from basketry.llm.decontaminate import contaminated, drop_contaminated, rarest_seeds, tile, tokens
from tests.conftest import rows

SF = "/root/testdata/sf0.01"
ITEM = "Alpha beta gamma delta epsilon zeta eta theta iota kappa."


@pytest.fixture(scope="module")
def tests_table(spark):
    return lambda *items: spark.createDataFrame(items, "item_id bigint, text string")


def test_tiles():
    item = tokens(ITEM)
    assert tile(item[5:] + ["x"] + item[:5], item) == [(5, 0, 6), (5, 5, 0)]
    assert tile(item[:4], item) == [] and tile([], item) == [] and tile(item, item[:4]) == []
    # A longer tile is taken first, though a shorter one begins earlier.
    assert tile(item[:6] + ["x"] + item[3:], item)[0] == (7, 3, 7)
    # Tiles overlap neither in the item nor in the text.
    assert tile(["a"] * 12, ["a"] * 7) == [(7, 0, 0)]
    long = [f"w{n}" for n in range(200)]
    assert sorted(tile(long[100:] + ["x"] + long[:100], long)) == [(100, 0, 101), (100, 100, 0)]


def naive_tiles(text, item, least):
    """The longest free common run, found by comparing every place with every place, marked again and again."""
    text_free, item_free, tiles = [True] * len(text), [True] * len(item), []
    while True:
        best = (0, 0, 0)
        for start in range(len(item)):
            for place in range(len(text)):
                size = 0
                while (
                    start + size < len(item) and place + size < len(text) and item_free[start + size] and text_free[place + size]
                    and item[start + size] == text[place + size]
                ):
                    size += 1
                best = max(best, (size, -start, -place))
        size, start, place = best[0], -best[1], -best[2]
        if size < least:
            return tiles
        tiles.append((size, start, place))
        for k in range(size):
            item_free[start + k] = text_free[place + k] = False


@pytest.mark.parametrize("seed", range(6))
def test_tiles_are_the_naive_ones(seed):
    draw = random.Random(seed)
    for _ in range(60):
        words = "abcdefgh"[: draw.randint(1, 8)]
        item = [draw.choice(words) for _ in range(draw.randint(1, 22))]
        text = [draw.choice(words) for _ in range(draw.randint(0, 30))]
        for _ in range(draw.randint(0, 3)):  # parts of the item, in any order
            low = draw.randrange(len(item))
            text += item[low : low + draw.randint(1, 12)]
        least = draw.choice([1, 2, 3, 5])
        assert tile(text, item, least) == naive_tiles(text, item, least)


def test_chosen_seeds_meet_every_tiling_that_reaches_the_threshold():
    draw = random.Random(4)
    for _ in range(300):
        n, least = draw.randint(5, 40), 5
        documents = [draw.choice([0, 1, 1, 5, 900]) for _ in range(n - least + 1)]
        spared = n - int(np.ceil(0.8 * n))
        chosen = rarest_seeds(documents, least, spared)
        # Runs of the test that a document could hold: all seeds inside are known.
        covered, held, at = 0, set(), 0
        while at < n:
            size = draw.randint(5, 12)
            run = range(at, min(at + size, n) - least + 1)
            if run and all(documents[p] for p in run) and draw.random() < 0.95:
                covered += min(at + size, n) - at
                held.update(run)
                at += size
            else:
                at += 1
        if covered >= n - spared:
            assert held & set(chosen)


def test_short_tests_and_scripts_without_spaces(documents, tests_table):
    chinese, thai = "人工智能正在改变我们的世界和生活方式。", "ปัญญาประดิษฐ์กำลังเปลี่ยนโลกของเรา"
    assert tokens("Ab 人工x9 é_ผู") == ["ab", "人", "工", "x9", "é_", "ผ"]
    docs = documents(
        (1, "Two plus two four"),
        (2, "we say: TWO plus two, four of them"),
        (3, "two plus two is four"),
        (4, chinese),
        (5, "前言。" + chinese + "后记"),
        (6, "人工智能很好"),
        (7, thai),
        (8, "yes"),
        (9, "…"),
    )
    tests = tests_table((1, "two plus two four"), (2, chinese), (3, thai), (4, "Yes!"), (5, "?!"), (6, ""))
    found = rows(contaminated(docs, tests), "doc_id", "item_id")
    assert found == [(1, 1), (2, 1), (4, 2), (5, 2), (7, 3), (8, 4)]


def test_a_seed_that_many_tests_and_documents_share(documents, tests_table, prose):
    """Only a test's rarest seeds meet documents: a phrase in all of them makes no pairs."""
    common = "which of the following statements is true about the thing"
    tests = tests_table(*[(i, f"{common} {prose(20, i)}") for i in range(30)])
    docs = documents(*[(i, f"{prose(15, 100 + i)} {common} {prose(15, 200 + i)}") for i in range(40)], (77, f"{common} {prose(20, 7)}"))
    assert rows(contaminated(docs, tests), "doc_id", "item_id") == [(77, 7)]


def test_other_texts_under_an_id_stay(documents, tests_table, prose):
    from pyspark.sql import functions as F

    docs = documents((6, ITEM), (6, prose(30, 1)), (None, ITEM), (None, prose(30, 2))).withColumns({n: F.lit(1) for n in ("__own0", "__OWN1", "doc_key")})
    kept = drop_contaminated(docs, tests_table((1, ITEM)))
    assert kept.columns == docs.columns and sorted(r.text for r in kept.collect()) == sorted([prose(30, 1), prose(30, 2)])


def test_given_documents(spark):
    """Every document against every test that shares five words with it, tiled one by one."""
    docs, tests = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    items = {r.item_id: tokens(r.text) for r in tests.collect()}
    owners = defaultdict(set)
    for item, words in items.items():
        for at in range(len(words) - 4):
            owners[tuple(words[at : at + 5])].add(item)
    expected = set()
    for doc in docs.collect():
        words = tokens(doc.text)
        for item in set().union(*(owners.get(tuple(words[at : at + 5]), set()) for at in range(len(words) - 4))):
            if sum(size for size, _, _ in tile(words, items[item])) >= 0.8 * len(items[item]) - 1e-9:
                expected.add((doc.doc_id, item))
    assert expected and {(r.doc_id, r.item_id) for r in contaminated(docs, tests).collect()} == expected


def test_reordered_and_partial(documents, clashing, tests_table, prose):
    swapped = " ".join([*ITEM.split()[5:], "and then", *ITEM.split()[:5]])
    docs = documents(
        (1, prose(40, 1) + " " + ITEM.upper() + " " + prose(40, 2)),
        (2, prose(40, 3) + "\n" + swapped),
        (3, " ".join(ITEM.split()[:7]) + " " + prose(30, 4)),
        (4, None),
        (5, prose(3000, 5)),
        (None, ITEM),
        (6, ITEM),
        (6, ITEM),
    )
    tests = tests_table((7, ITEM), (8, "not there"), (9, None), (None, ITEM), (7, ITEM))
    found = rows(contaminated(clashing(docs), clashing(tests)), "doc_id", "item_id", "n_covered", "n_tiles")
    assert found == [
        (None, None, 10, 1), (None, 7, 10, 1), (1, None, 10, 1), (1, 7, 10, 1), (2, None, 10, 2), (2, 7, 10, 2), (6, None, 10, 1), (6, 7, 10, 1),
    ]
    kept = drop_contaminated(clashing(docs), tests)
    assert kept.columns == clashing(docs).columns and rows(kept, "doc_id") == [(3,), (4,), (5,)]
    assert contaminated(docs.limit(0), tests).count() == 0
    assert contaminated(docs, tests.limit(0)).count() == 0
    assert drop_contaminated(docs, tests.limit(0)).count() == 8
