"""A training-data pipeline: every stage works on all documents its predecessor kept.

All stages but the last return the columns of ``documents``; the last returns the packed pieces. Odd rows: an empty table gives
an empty table in every stage, whole texts are worked on however long they are, and columns beside doc_id, text, source and n_chars are passed
on whatever their names are (but for the last stage, which returns pieces).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyforge.llm import jaccard, mixing, packing, pii, toxicity
from tallyforge.llm.common import table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go. Null and empty texts have the score of a text without words, repeated rows go or stay together, rows of a null doc_id are scored like others."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the documents that links of shingle sets join, the one with the smallest id stays. Five words and 0.8; op9's own are 4 and 0.85.

    Of several rows of one doc_id one stays; rows without a doc_id, and without words (once a doc_id), stay.
    """
    return jaccard.one_of_each(docs, width=5, percent=80)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by the name of its kind. A null text stays null, an empty one empty; repeated rows get equal texts, a null doc_id is like any other."""
    return pii.masked(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are cut, or repeated, to their target shares. Null texts have no words, null sources are one source, the last; of equal rows at a cut as many are taken as fit."""
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 ids. Null and empty texts are the end id alone, repeated rows and equal ids are packed each on their own, a null doc_id stays null."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", without_toxic),
    ("ngram_jaccard_join", without_near_copies),
    ("personal_data", without_personal_data),
    ("mixing", mixed),
    ("packing", packed),
]

#: Token ids and the trained tagger are beyond SQL; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; each stage's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}")
    return docs
