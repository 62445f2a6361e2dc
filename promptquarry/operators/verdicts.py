"""Verdicts of a model on rule pairs, and manual labels. The model is injected; offline it is a table of recorded verdicts."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocabulary as V
from . import labels

DEFAULT_CONFIDENCE = 0.7
PAIR_COLUMNS = (
    "session_id", "originating_prompt_id", "clarifying_prompt_id", "clarification_kind", "clarification_text", "extraction_method", "extractor_version",
    "confidence", "reason",
)


class ClarificationExtractor(Protocol):
    """LLM2: rule pairs with both contents to (pair_id, accepted, kind, text, confidence, reason, error_class, error_status,
    error_message, fresh_tokens, cached_tokens, out_tokens, latency_ms). A failed call has accepted null."""

    def extract(self, pairs: DataFrame) -> DataFrame: ...


class RecordedVerdicts:
    """LLM2: verdicts from a table instead of a model."""

    def __init__(self, verdicts: DataFrame):
        self.verdicts = verdicts

    def extract(self, pairs: DataFrame) -> DataFrame:
        return pairs.select("pair_id").join(self.verdicts, "pair_id")


def judged(pairs: DataFrame, prompts: DataFrame, extractor: ClarificationExtractor, version: str, retry: bool = False) -> DataFrame:
    """Rule pairs with their verdicts: all of them, or with retry those whose origin has no llm row yet. An llm row of this
    version goes before a full pass, so it doesn't count."""
    todo = labels.by_method(pairs, "rule")
    if retry:
        todo = todo.join(labels.retry_missing(pairs).select("pair_id"), "pair_id", "left_semi")
    asked = labels.with_contents(todo, prompts)
    verdicts = extractor.extract(asked.select("pair_id", "orig_content", "clar_content", "clarification_kind", "clarification_text"))
    rule = todo.select("pair_id", "session_id", "originating_prompt_id", "clarifying_prompt_id", F.col("clarification_kind").alias("rule_kind"))
    failed = F.col("accepted").isNull()
    outcome = F.when(failed, "failed").when(F.col("accepted"), "accepted").otherwise("rejected")
    refined = F.coalesce(F.col("accepted") & (F.nullif("kind", F.lit("")) != F.col("rule_kind")), F.lit(False))
    return rule.join(verdicts, "pair_id").withColumns({
        "outcome": outcome, "refined": refined, "extractor_version": F.lit(version), "cost_usd": T.cost_usd(F.col("fresh_tokens"), F.col("cached_tokens"), F.col("out_tokens")),
    })


def accepted_rows(rows: DataFrame) -> DataFrame:
    """LAB3, SNK8: the llm pairs of accepted verdicts that have a kind and a text; from_pair_id is the rule pair."""
    some = "outcome = 'accepted' AND coalesce(kind, '') <> '' AND coalesce(text, '') <> ''"
    return rows.filter(some).select(
        F.col("pair_id").alias("from_pair_id"), "session_id", "originating_prompt_id", "clarifying_prompt_id", F.col("kind").alias("clarification_kind"),
        F.col("text").alias("clarification_text"), F.lit("llm").alias("extraction_method"), "extractor_version", F.coalesce("confidence", F.lit(DEFAULT_CONFIDENCE)).alias("confidence"), "reason",
    )


def failed_rows(rows: DataFrame) -> DataFrame:
    """SNK9: the ledger of failed calls; a call without a message keeps its reason."""
    return rows.filter("outcome = 'failed'").select("pair_id", "extractor_version", "error_class", "error_status", F.coalesce("error_message", "reason").alias("error_message"))


def tally(rows: DataFrame) -> DataFrame:
    """AGG21: verdicts by outcome and, for failed ones, by error class and status."""
    failed = F.col("outcome") == "failed"
    tag = F.when(failed, F.concat(F.coalesce(F.nullif("error_class", F.lit("")), F.lit("Unknown")), F.coalesce(F.concat(F.lit("("), F.col("error_status").cast("string"), F.lit(")")), F.lit(""))))
    return rows.groupBy("outcome", tag.alias("error")).agg(F.count("*").alias("n"), F.count_if("refined").alias("refined"), F.sum("cost_usd").alias("cost_usd"), F.avg("latency_ms").alias("mean_latency_ms"))


def verdict_pass(pairs: DataFrame, prompts: DataFrame, extractor: ClarificationExtractor, version: str, retry: bool = False) -> dict[str, DataFrame]:
    """LAB3: pairs (with the new llm rows; a full pass replaces this version's), failed (new rows of the ledger) and tally.
    pairs needs no ids here: they are given where the table is written."""
    rows = judged(pairs, prompts, extractor, version, retry)
    new = accepted_rows(rows).select(*PAIR_COLUMNS)
    own = pairs.select(*PAIR_COLUMNS)
    out = own.unionByName(new) if retry else labels.with_method_rows(own, new, "llm", version)
    return {"pairs": out, "failed": failed_rows(rows), "tally": tally(rows)}


def manual_rows(pairs: DataFrame, decisions: DataFrame, version: str) -> DataFrame:
    """SNK10, LAB6: manual pairs of decisions (pair_id, action, kind, text, reason). accept keeps the pair's kind and text,
    edit takes the text, fix-kind the kind, reject notes a rejection with its reason; skip and others give nothing."""
    action = F.col("action")
    rejected = action == "reject"
    text = F.when(rejected, V.REJECTED).when(action == "edit", F.col("text")).otherwise(F.col("clarification_text"))
    kind = F.when(~rejected, F.when(action == "fix-kind", F.col("kind")).otherwise(F.col("clarification_kind")))
    rows = pairs.select("pair_id", "session_id", "originating_prompt_id", "clarifying_prompt_id", "clarification_kind", "clarification_text")
    rows = rows.join(decisions.select("pair_id", "action", "kind", "text", F.col("reason").alias("__reason")), "pair_id").filter(action.isin("accept", "edit", "fix-kind", "reject"))
    return rows.select(
        F.col("pair_id").alias("from_pair_id"), "session_id", "originating_prompt_id", "clarifying_prompt_id", kind.alias("clarification_kind"), text.alias("clarification_text"),
        F.lit("manual").alias("extraction_method"), F.lit(version).alias("extractor_version"), F.lit(None).cast("double").alias("confidence"), F.when(rejected, F.col("__reason")).alias("reason"),
    )
