"""A training corpus in five stages over ``documents``.

Each stage is (name, function of (spark, docs, sf_dir)) and works on all rows that its predecessor
kept. All but the last return the columns of ``documents``; the last adds ``size``, ``target`` and
``taken``, the words that the mix takes of a document. Between stages the rows are written to the
shared folder as Parquet and read again, so that a lost executor costs one stage at most.

In every stage null texts count as empty, columns beyond doc_id, text and source stay as they are
whatever their names, repeated rows are judged alike, and an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from failscope.llm import decontamination, exact_dedup, mixing, near_dedup, quality
from failscope.llm.common import materialise, table


def accept_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it is fitted on the rows of ``labels``.

    Labels with a null are ignored, and of a doc_id with several labels the majority counts. Without
    two classes of labels all scores are alike and the same verdict holds for all.
    """
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, the row of the smallest doc_id.

    Rows that repeat that doc_id all stay; null doc_ids lose against any other, and stay where a
    text has no other.
    """
    return exact_dedup.without_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document of the smallest doc_id.

    Texts without a word are in no group and stay, as do rows of null doc_id.
    """
    return near_dedup.one_of_each_class(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no item of ``benchmark``. Null and empty items are in no document."""
    return decontamination.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes words of, and how many.

    Null sources are one source, the last. Ties of the keys go by doc_id and size. Texts without
    words are in no mix.
    """
    return mixing.mixed_documents(docs)


STAGES = [
    ("quality classifier", accept_quality),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix),
]

#: Neither boosted lookup tables nor the forest's groups can be stated in SQL; tests hold the result
#: against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
