"""From raw documents to a training mix: language ID, exact and near deduplication, decontamination, mixing.

Each stage calls one of the operators of promptquarry.llm on what its predecessor kept and returns the columns of
documents; the last one gives a row per epoch in which a document is taken and adds epoch and taken. Near duplicates
are those with a similarity of 0.8 or more on shingles of five words. Defined cases are those of the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from promptquarry.llm import decontamination, exact_dedup, language_id, mixing, near_dedup
from promptquarry.llm.common import stored, table

NEAR_PERCENT = 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an identifiable language go."""
    return language_id.keep_identified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one stays."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one stays."""
    return near_dedup.keep_one_of_each(docs, NEAR_PERCENT)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources meet their target weights."""
    return mixing.mixed_rows(docs)


STAGES = [("language", language), ("exact", exact), ("near", near), ("decontaminate", decontaminate), ("mix", mix)]

#: Language models, MinHash and SimHash have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
