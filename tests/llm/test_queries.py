"""The registered queries: those with SQL against it, and that the rest of the library does without them."""

from __future__ import annotations

import ast
import re
from pathlib import Path

import pytest

from basketry.llm.queries import oracle_sql, queries
from tests.oracle_check import connect, difference

SMALL = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[2]


def test_one_query_for_each_operator():
    assert [int(re.match(r"op(\d+)_", name).group(1)) for name in queries()] == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_sql(spark, name):
    assert difference(queries()[name](spark, SMALL), connect(SMALL), oracle_sql()[name]) is None


CONTRACTS = {
    "op1_html_extraction": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
    "op2_exact_dedup": {"doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean", "text_sha256": "string"},
    "op5_suffix_array_dedup": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
    "op6_url_filter": {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"},
    "op7_quality_classifier": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op8_source_mixing": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op10_minhash_near_dedup": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op11_conversation_repair": {"conv_id": "bigint", **dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal", "cost"), "bigint"), "audit": "string", "repaired_sha256": "string"},
    "op12_chat_format": {"conv_id": "bigint", "n_turns": "bigint", "turns_sha256": "string", "loss_chars": "bigint", "loss_sha256": "string", "formatted_chars": "bigint"},
    "op13_phrase_collocations": {"lang": "string", "phrase": "string", **dict.fromkeys(("rank", "a", "l", "r", "n", "score"), "bigint")},
}


@pytest.mark.parametrize("name", sorted(CONTRACTS))
def test_columns(spark, name):
    found = dict(queries()[name](spark, SMALL).dtypes)
    assert CONTRACTS[name].items() <= found.items()


def test_nothing_else_imports_this_package():
    others = [p for p in (ROOT / "basketry").rglob("*.py") if "llm" not in p.parts] + list((ROOT / "tests").glob("*.py")) + [ROOT / "bench.py"]
    for path in others:
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") or n == "corpus_pipeline" for n in names), path
