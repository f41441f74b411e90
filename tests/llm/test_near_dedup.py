from __future__ import annotations

from random import Random

import numpy as np
import pytest

from basketry.llm import near_dedup
from basketry.llm.near_dedup import drop_near_duplicates, near_duplicates
from tests.conftest import rows

SF = "/root/testdata/sf0.01"


def shingles(text, length):
    words = (text or "").encode().lower().split()
    if len(words) < length:
        return {tuple(words)} if words else set()
    return {tuple(words[at : at + length]) for at in range(len(words) - length + 1)}


def brute(documents, length, top=80, bottom=100):
    """Every pair of documents that share a shingle; rows of one id are one document."""
    sets = [(i, shingles(t, length)) for i, t in documents]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for at, (a, one) in enumerate(sets):
        for b, two in sets[:at]:
            common = len(one & two)
            if a is not None and b is not None and common and bottom * common >= top * (len(one) + len(two) - common):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    found = [(i, len(s), None if i is None else find(i), i is None or find(i) == i) for i, s in sets]
    return sorted(found, key=lambda t: [(v is not None, str(type(v)), v) for v in t])


@pytest.fixture(scope="module")
def cases(prose):
    """Chains, stars around one document, groups of copies, pairs at the threshold, short and empty texts."""
    draw, found = Random(5), []

    def edited(words, edits):
        words = list(words)
        for at in draw.sample(range(len(words)), edits):
            words[at] = f"new{draw.random()}"
        return words

    base = prose(200, 1).split()
    chain = base
    for n in range(30):
        chain = edited(chain, 6)
        found.append((1000 - n, " ".join(chain)))
    star = prose(150, 2).split()
    found.append((500, " ".join(star)))
    found += [(501 + n, " ".join(edited(star, 7 + n % 8))) for n in range(60)]
    found += [(700 + n, " ".join(star).upper()) for n in range(20)]
    for n in range(40):
        text = prose(30 + n, 10 + n).split()
        found += [(100 + 2 * n, " ".join(text)), (101 + 2 * n, "  ".join(edited(text, 1 + n % 4)))]
    # A set of 5 and one of 4 of them: exactly 0.8.
    found += [(1, "a b c d e f"), (2, "b c d e f"), (3, "c d e f"), (4, "x"), (5, "X"), (6, "x y"), (7, ""), (8, None), (9, " \t "), (10, "\x1fx"), (11, "x\x85y")]
    found += [(None, "a b c d e f"), (None, "a b c d e f"), (12, "q r s t u v w"), (12, "q r s t u v w"), (12, "a b c d e f g h i")]
    return found


@pytest.mark.parametrize("length", [2, 5])
def test_brute_force(documents, clashing, cases, length):
    assert rows(near_duplicates(clashing(documents(*cases)), shingle=length)) == brute(cases, length)


def test_regions_beyond_a_block(documents, cases, monkeypatch):
    """Blocks of four documents: the second comparison finds what the first leaves apart."""
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    assert rows(near_duplicates(documents(*cases), shingle=2)) == brute(cases, 2)


def test_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 500")
    assert rows(near_duplicates(docs, shingle=2)) == brute([(r.doc_id, r.text) for r in docs.collect()], 2)


def test_empty_table_and_stage(documents, clashing, cases):
    assert near_duplicates(documents((1, "a")).limit(0)).count() == 0
    docs = clashing(documents(*cases))
    kept = drop_near_duplicates(docs, shingle=2)
    assert kept.columns == docs.columns
    assert rows(kept, "doc_id") == sorted([(i,) for i, _, _, stays in brute(cases, 2) if stays], key=lambda t: (t[0] is not None, t))


def test_signature_bytes_estimate_similarity(prose):
    words = prose(400, 3).encode().split()
    other = words[:330] + prose(70, 4).encode().split()
    hashes = near_dedup._ByteHashes()
    one, two = (near_dedup.shingle_set(w, 2, hashes) for w in (words, other))
    common = len(np.intersect1d(one, two))
    exact = common / (len(one) + len(two) - common)
    a, b = (near_dedup._signature(s)[: near_dedup.SIGNATURE] for s in (one, two))
    assert abs((a == b).mean() - exact) < 0.15


def test_regions_are_divided_at_the_shortest_common_prefixes():
    """Three crowds of a region: each part holds one of them, or the beginning of one that is too large."""
    import numpy as np
    import pyarrow as pa

    from basketry.llm.near_dedup import BLOCK, SIGNATURE, _groups, common_prefixes, shallowest

    draw = np.random.default_rng(1)
    rows_of = []
    for lead, count in ((1, 300), (2, 200), (3, 400)):
        part = draw.integers(0, 256, (count, SIGNATURE)).astype(np.uint8)
        part[:, :6], part[:, 5] = 9, lead
        part[:, 6:20] = lead
        rows_of += [r.tobytes() for r in part]
    rows_of.sort()
    table = pa.RecordBatch.from_arrays([pa.array(np.zeros(900, np.int64)), pa.array(np.arange(900)), pa.array(rows_of, pa.binary())], names=["prefix", "node", "signature"])
    parts = [p["node"].tolist() for p in _groups(iter([table]), "prefix", shallowest)]
    assert sum(parts, []) == list(range(900)) and parts[0] == list(range(300)) and max(map(len, parts)) <= 2 * BLOCK
    assert 500 in [p[0] for p in parts] or any(p[0] == 300 for p in parts)
    signatures = np.frombuffer(b"".join(rows_of), dtype=np.uint8).reshape(-1, SIGNATURE)
    plain = [next((k for k in range(SIGNATURE) if a[k] != b[k]), SIGNATURE) for a, b in zip(signatures, signatures[1:])]
    assert common_prefixes(signatures).tolist() == plain
