"""Evaluation runs: cases of three modes, retrieval, a generator, scores and a budget, as rows of cases and of the run.

A case has case_id (its place in the run), prompt, project_id, originating_prompt_id, gold_pair_id, gold_kind, gold_text and
shape. The generator is injected and answers by case (as prompt_id); offline it is a table of recorded answers.
"""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.store import kept
from . import labels, scoring, search
from .checks import QuestionGenerator

RETRIEVED, KEPT = 10, 8
QUESTIONS = "array<struct<text:string,kind:string,confidence:double>>"
SHAPES_FILE = Path(__file__).with_name("shape_prompts.json")


def _of_pairs(rows: DataFrame, prompts: DataFrame) -> DataFrame:
    orig = prompts.select(F.col("prompt_id").alias("originating_prompt_id"), F.col("content").alias("prompt"), "project_id")
    rows = rows.join(orig, "originating_prompt_id")
    return rows.select(
        F.col("pair_id").alias("case_id"), "prompt", "project_id", "originating_prompt_id", F.col("pair_id").alias("gold_pair_id"), F.col("clarification_kind").alias("gold_kind"),
        F.col("clarification_text").alias("gold_text"), F.lit(None).cast("string").alias("shape"),
    )


def gold_cases(pairs: DataFrame, prompts: DataFrame, projects: DataFrame, own: str = labels.OWN_TOOL) -> DataFrame:
    """JN9: manual pairs of foreign projects; a rejection has no kind. As a table the projects are known to be few, and no text is
    shuffled by its project."""
    ok = kept(projects.filter(labels.foreign_project(F.col("name"), F.col("cwd"), own)).select("project_id").distinct(), "foreign-projects")
    return _of_pairs(labels.by_method(pairs, "manual"), prompts).join(ok, "project_id", "left_semi")


def wide_cases(pairs: DataFrame, prompts: DataFrame, projects: DataFrame, own: str = labels.OWN_TOOL) -> DataFrame:
    """JN10: llm pairs without a manual label."""
    first = labels.wide_cases(pairs, prompts, projects, own).select("pair_id")
    return _of_pairs(labels.by_method(pairs, "llm").join(first, "pair_id", "left_semi"), prompts)


def shape_cases(spark: SparkSession, path: str | None = None) -> DataFrame:
    """SRC11: prompts by shape, from a JSON file {"prompts": [{"shape", "text"}]}; by default the bundled one. They have no
    gold and no project."""
    if path:
        rows = spark.read.option("multiLine", "true").schema("prompts array<struct<shape:string,text:string>>").json(path).select(F.posexplode("prompts").alias("case_id", "p"))
    else:
        held = json.loads(SHAPES_FILE.read_text(encoding="utf-8"))["prompts"]
        rows = spark.createDataFrame([(i, (p["shape"], p["text"])) for i, p in enumerate(held)], "case_id long, p struct<shape:string,text:string>")
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    return rows.select(
        F.col("case_id").cast("long").alias("case_id"), F.col("p.text").alias("prompt"), none("long", "project_id"), none("long", "originating_prompt_id"), none("long", "gold_pair_id"),
        none("string", "gold_kind"), none("string", "gold_text"), F.col("p.shape").alias("shape"),
    )


def retrieved_for(cases: DataFrame, prompts: DataFrame, projects: DataFrame, own: str = labels.OWN_TOOL, porter: bool = True) -> DataFrame:
    """EVL3: case_id, found_id, pos: the best rows of the corpus for a case, without the case's own origin."""
    queries = cases.select(F.col("case_id").alias("query_id"), F.col("prompt").alias("text"), "project_id")
    found = search.retrieve(queries, prompts, projects, RETRIEVED, porter=porter, own=own).select(F.col("query_id").alias("case_id"), F.col("prompt_id").alias("found_id"), "pos")
    origin = cases.select("case_id", "originating_prompt_id")
    found = found.join(origin, "case_id").filter(~F.col("found_id").eqNullSafe(F.col("originating_prompt_id"))).drop("originating_prompt_id")
    place = F.row_number().over(Window.partitionBy("case_id").orderBy("pos"))
    return kept(found.withColumn("pos", place.cast("long")).filter(F.col("pos") <= KEPT), "found")


def run_cases(cases: DataFrame, found: DataFrame, pairs: DataFrame, generator: QuestionGenerator, run_id: int, budget_usd: float = 2.0) -> DataFrame:
    """EVL3, EVL4, SNK12, WIN10: one row per case that ran. A run ends with the case whose cost takes it over the budget. Cases
    whose call failed have no questions and are scored as such; cases without a gold have no scores."""
    found_ids = found.groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "found_id"))), lambda x: x["found_id"]).alias("retrieved_ids"))
    shown = search.gold_examples(found.select(F.col("case_id").alias("query_id"), F.col("found_id").alias("prompt_id")), pairs)
    shown = shown.groupBy(F.col("query_id").alias("case_id")).agg(F.count("*").alias("n_examples"))
    asked = cases.select(F.col("case_id").alias("prompt_id"), F.col("prompt").alias("content"))
    answers = generator.generate(asked).withColumnRenamed("prompt_id", "case_id")
    rows = cases.join(answers, "case_id", "left").join(found_ids, "case_id", "left").join(shown, "case_id", "left")
    rows = rows.withColumns({
        "questions": F.coalesce("questions", F.array().cast(QUESTIONS)), "retrieved_ids": F.coalesce("retrieved_ids", F.array().cast("array<long>")),
        "n_examples": F.coalesce("n_examples", F.lit(0)), "cost_usd": T.cost_usd(F.col("fresh_tokens"), F.col("cached_tokens"), F.col("out_tokens")), "run_id": F.lit(run_id).cast("long"),
    })
    ran = kept(scoring.within_budget(rows, budget_usd).drop("spent_before"), "ran")
    has_gold = F.col("gold_pair_id").isNotNull()
    scores = scoring.score_cases(ran.filter(has_gold).select("case_id", "gold_kind", "gold_text", "questions")).select("case_id", "overlap_at_1", "overlap_at_3", "kind_match_top1", "kind_match_any")
    marks = scoring.instrumented(ran.select("case_id", "prompt", "questions", "gold_kind"))
    kinds = scoring.score_questions(ran.filter(has_gold).select("case_id", "gold_kind", "gold_text", "questions")).groupBy("case_id")
    kinds = kinds.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "kind"))), lambda x: x["kind"]).alias("matched_kinds"))
    rows = ran.join(scores, "case_id", "left").join(marks, "case_id", "left").join(kinds, "case_id", "left")
    return rows.select(
        "run_id", "case_id", "originating_prompt_id", "gold_pair_id", "shape", F.when(F.col("originating_prompt_id").isNull(), F.col("prompt")).alias("synthetic_prompt"),
        F.to_json("questions").alias("proposed_questions_json"), "gold_kind", "gold_text", "overlap_at_1", "overlap_at_3", "kind_match_top1", "kind_match_any",
        F.when(has_gold, F.coalesce("matched_kinds", F.array().cast("array<string>"))).alias("matched_kinds"), "retrieved_ids", "n_examples", "latency_ms", "cost_usd",
        has_gold.alias("is_in_gold_subset"), "vague_verb", "has_disambiguation", "live_or_local", F.when(has_gold, F.col("correct_skip")).alias("correct_skip"), "error_class",
    )


def run_row(rows: DataFrame, mode: str) -> DataFrame:
    """SNK12: the run itself. Cases without scores count as cases, but not in the means."""
    mean = lambda c: F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0))
    return rows.groupBy("run_id").agg(
        F.lit(mode).alias("mode"), F.lit("bm25").alias("retrieval_method"), F.lit(KEPT).cast("long").alias("retrieval_k"), F.count("*").alias("case_count"),
        mean("overlap_at_1").alias("overlap_at_1"), mean("overlap_at_3").alias("overlap_at_3"), mean("kind_match_any").alias("kind_match_rate"), F.sum("cost_usd").alias("total_cost_usd"),
    )
