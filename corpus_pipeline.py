"""A corpus from documents: quality, exact and near duplicates, benchmark passages, and a mix of the sources.

Each stage takes what its predecessor kept, written as Parquet and read again, and returns documents with all their
columns; the last returns the mix, in which a document may stand twice. Run it on a folder of tables with
``run(spark, folder)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from basketry.llm.common import open_table
from basketry.llm.decontaminate import drop_contaminated
from basketry.llm.exact_dedup import drop_exact_duplicates
from basketry.llm.mixing import mixed_documents
from basketry.llm.near_dedup import drop_near_duplicates
from basketry.llm.quality import fit_quality, keep_quality
from basketry.sources.tables import save_table, scratch_root


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it learns from the labelled ones of the whole table.

    A null text is judged as an empty one. Repeated rows share one verdict. Without usable labels every document has the
    same score, above the threshold, and stays. Columns of any name pass through, empty tables too.
    """
    labelled = open_table(spark, sf_dir, "documents")
    return keep_quality(docs, fit_quality(labelled, open_table(spark, sf_dir, "labels")))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, the one with the smallest id.

    Null and empty texts are one text. A null id stays only where its text has no other id. Of rows that repeat an id and
    a text one stays, whichever. Columns of any name pass through, empty tables too.
    """
    return drop_exact_duplicates(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more.

    The one with the smallest id stays. Texts without words, and rows with a null id, are like nothing and stay. Rows that
    repeat an id are one document and share one verdict. Columns of any name pass through, empty tables too.
    """
    return drop_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark.

    Null and empty texts hold none and stay. Rows that repeat a text share one verdict, whatever their ids. Tests without
    words are never found. Columns of any name pass through; without documents nothing, without tests everything stays.
    """
    return drop_contaminated(docs, open_table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources to their target weights.

    A null text has no words and is taken zero or more times like any other; a null source is a source, the last one.
    Rows that repeat an id, source and size share one verdict. A document stands as often as it is taken, twice at most.
    Columns of any name pass through, an empty table gives an empty mix.
    """
    return mixed_documents(docs)


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]

# A trained model and the balanced draw are beyond SQL; the tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_root(spark)
    docs = open_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save_table(stage(spark, docs, sf_dir), root, name)
    return STAGES[-1][1](spark, docs, sf_dir)
