"""Every registered query against its SQL, and the known results of the whole flow."""

import pytest

import __spark_entry__ as entry
from basketry.plans import oracle as plan_oracle, queries as plan_queries
from tests.oracle_check import connect, difference

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    return connect(SMALL)


def test_every_query_has_sql():
    assert set(plan_queries.queries()) == set(plan_oracle.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(plan_queries.queries()))
def test_query_matches_sql(spark, oracle, name):
    assert difference(entry.queries()[name](spark, SMALL), oracle, entry.oracle_sql()[name]) is None


def test_entry_gives_the_known_metrics(spark):
    got = {(r.baseline_name, r.k): (r.recall, r.precision, r.ndcg) for r in entry.entry(spark).collect()}
    known = {
        ("cooccurrence", 10): (0.11875, 0.0625, 0.126736),
        ("cooccurrence", 50): (0.254167, 0.0325, 0.183622),
        ("cooccurrence", 100): (0.570833, 0.03875, 0.280131),
        ("popularity", 10): (0.0625, 0.025, 0.062903),
        ("popularity", 50): (0.304167, 0.04, 0.166607),
        ("popularity", 100): (0.580208, 0.03875, 0.250048),
    }
    assert set(got) == set(known)
    for key, values in known.items():
        assert got[key] == pytest.approx(values, abs=1e-6)


def test_a_missing_library_of_the_operators_leaves_the_rest(monkeypatch):
    def missing(name):
        return lambda _: (_ for _ in ()).throw(ImportError(f"no {name}", name=name))

    for name in ("basketry.llm", "basketry.llm.queries", "corpus_pipeline"):
        monkeypatch.setattr(entry, "import_module", missing(name))
        assert entry._optional("basketry.llm.queries") is None
    monkeypatch.setattr(entry, "import_module", missing("xxhash"))
    with pytest.warns(UserWarning, match="no xxhash"):
        assert entry._optional("basketry.llm.queries") is None
    monkeypatch.setattr(entry, "import_module", missing("basketry.operators"))
    with pytest.raises(ImportError):
        entry._optional("basketry.llm.queries")
    monkeypatch.setattr(entry, "_llm", None)
    monkeypatch.setattr(entry, "_pipeline", None)
    assert set(entry.queries()) == set(plan_queries.queries()) and set(entry.oracle_sql()) == set(plan_oracle.oracle_sql())
