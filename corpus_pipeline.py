"""The corpus pipeline: stages over ``documents``, each on all that its predecessor kept.

A null or empty text has no language and goes in the first stage; rows with a null ``doc_id`` take part as
documents of their own; a table without rows passes through. Columns besides those of ``documents`` stay.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from steadymark.llm import decontaminate, jaccard_join, language_id, packing, private_terms
from steadymark.llm.common import keep, table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have one of the learned languages."""
    return language_id.kept(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five words, a similarity of 0.8."""
    return jaccard_join.one_of_each(docs)


def unseen_by_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of ``benchmark``."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data, and words that disclose it, replaced."""
    return private_terms.sanitised(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in windows of 4096 ids."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", known_language),
    ("jaccard_join", one_of_each),
    ("decontamination", unseen_by_benchmark),
    ("private_terms", without_personal_data),
    ("packing", packed),
]
#: Language ID, disclosing words and packing cannot be stated in SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``; every stage's rows are written as Parquet and reread."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir))
    return docs
