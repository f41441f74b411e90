from __future__ import annotations

import pytest

DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that operators use for their results or inside.
CLASHES = ("kept", "score", "component_id", "keep_id", "key", "hash", "n", "size", "node", "target", "__key", "features", "path", "host")


def _document(doc_id, text, source="src0"):
    return (doc_id, text, "en", source, None if text is None else len(text))


@pytest.fixture(scope="session")
def documents(spark):
    """(id, text[, source]) rows as a table of documents."""

    def make(*rows):
        return spark.createDataFrame([_document(*r) for r in rows], DOC_SCHEMA)

    return make


@pytest.fixture(scope="session")
def clashing():
    """The same table with columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    return lambda frame: frame.withColumns({c: F.lit("x") for c in CLASHES})


@pytest.fixture(scope="session")
def prose():
    """Words of invented prose, the same for the same seed."""
    from random import Random

    syllables = "an er on the re ti st nd ou ea ing ha".split()

    def make(count, seed):
        draw = Random(seed)
        return " ".join("".join(draw.choice(syllables) for _ in range(draw.randint(1, 4))) for _ in range(count))

    return make
