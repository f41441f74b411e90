from __future__ import annotations

from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from basketry.llm.exact_dedup import drop_exact_duplicates, exact_duplicates
from tests.conftest import rows


def brute(documents, keep):
    groups = {}
    for doc_id, text in documents:
        groups.setdefault(text or "", []).append(doc_id)
    found = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        stays = keep(known) if known else None
        found += [(i, stays, len(ids), i == stays, sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(found, key=lambda t: [(v is not None, str(type(v)), v) for v in t])


DOCUMENTS = [(5, "a"), (3, "a"), (9, "b"), (None, "b"), (1, None), (2, ""), (4, "A"), (7, "é" * 50_000), (6, "é" * 50_000), (8, "x"), (8, "x"), (None, "z")]


@pytest.mark.parametrize(("keep", "choose"), [("smallest", min), ("largest", max)])
def test_brute_force(documents, clashing, keep, choose):
    assert rows(exact_duplicates(clashing(documents(*DOCUMENTS)), keep)) == brute(DOCUMENTS, choose)


def test_collisions_are_told_apart(documents):
    """A hash of one value for all texts: the comparison of bytes alone decides."""
    found = exact_duplicates(documents(*DOCUMENTS), "largest", content_hash=lambda text: F.lit("same"))
    assert rows(found) == brute(DOCUMENTS, max)


def test_empty_table(documents):
    assert exact_duplicates(documents((1, "a")).limit(0)).count() == 0
    with pytest.raises(ValueError):
        exact_duplicates(documents((1, "a")), "any")


def test_stage_keeps_rows_and_columns(documents, clashing):
    docs = clashing(documents(*DOCUMENTS))
    kept = drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    assert rows(kept, "doc_id", F.substring("text", 1, 3)) == [(None, "z"), (1, None), (3, "a"), (4, "A"), (6, "ééé"), (8, "x"), (9, "b")]
