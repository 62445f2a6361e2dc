"""Replayed prompts: one canonical row per session and text, and references that follow it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

LEAST_LENGTH = 10


def replay_groups(prompts: DataFrame) -> DataFrame:
    """AGG10, FLT11-12: session_id, normalized_content, canonical_id, n. prompts with normalized_content."""
    rows = prompts.filter((F.col("role") == "user") & F.col("normalized_content").isNotNull() & (F.length(T.trimmed(F.col("normalized_content"))) >= LEAST_LENGTH))
    return rows.groupBy("session_id", "normalized_content").agg(F.min("prompt_id").alias("canonical_id"), F.count("*").alias("n")).filter("n > 1")


def canonical_ids(prompts: DataFrame) -> DataFrame:
    """prompt_id, canonical_id of the rows that a canonical one replaces."""
    own = prompts.filter("role = 'user'").select("session_id", "normalized_content", "prompt_id")
    return own.join(replay_groups(prompts), ["session_id", "normalized_content"]).filter("prompt_id <> canonical_id").select("prompt_id", "canonical_id")


def repointed(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """SNK14: a reference to a replaced prompt becomes one to the canonical prompt."""
    new = ids.select(F.col("prompt_id").alias("__old"), F.col("canonical_id").alias("__new"))
    return rows.join(new, F.col(column) == F.col("__old"), "left").withColumn(column, F.coalesce("__new", column)).drop("__old", "__new")


def deduped_prompts(prompts: DataFrame) -> DataFrame:
    """LAB7: the prompts that stay."""
    return prompts.join(canonical_ids(prompts).select("prompt_id"), "prompt_id", "left_anti")


def deduped_pairs(pairs: DataFrame, prompts: DataFrame) -> DataFrame:
    """LAB7, FLT16, AGG11, JN17: re-pointed pairs without self-references, the first pair_id of each (origin,
    clarifier, method, version). As no kind is in that key, pairs that differ in kind only collapse too."""
    ids = canonical_ids(prompts)
    for column in ("originating_prompt_id", "clarifying_prompt_id"):
        pairs = repointed(pairs, ids, column)
    pairs = pairs.filter("originating_prompt_id <> clarifying_prompt_id")
    first = pairs.groupBy("originating_prompt_id", "clarifying_prompt_id", "extraction_method", "extractor_version").agg(F.min("pair_id").alias("pair_id"))
    return pairs.join(first.select("pair_id"), "pair_id", "left_semi")
