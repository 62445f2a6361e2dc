"""Verdicts and manual labels over clarifying pairs. pairs: pair_id, originating_prompt_id, clarifying_prompt_id,
session_id, clarification_kind, clarification_text, extraction_method, extractor_version, confidence, reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OWN_TOOL = "own-tool"
CONTENT_KEY = ["session_id", "orig_norm", "clar_norm"]


def by_method(pairs: DataFrame, method: str) -> DataFrame:
    return pairs.filter(F.col("extraction_method") == method)


def foreign_project(name: Column, cwd: Column, own: str = OWN_TOOL) -> Column:
    """FLT9: not the tool's own project; a project without a name is out too."""
    return (name != own) & (cwd.isNull() | ~cwd.ilike(f"%{own}%"))


def with_contents(pairs: DataFrame, prompts: DataFrame) -> DataFrame:
    """JN8: pairs with both prompts' normalized text (null as empty), the origin's text, turn and project."""
    norm = F.coalesce("normalized_content", F.lit(""))
    orig = prompts.select(F.col("prompt_id").alias("originating_prompt_id"), norm.alias("orig_norm"), F.col("content").alias("orig_content"), F.col("turn_index").alias("orig_turn"), "project_id")
    clar = prompts.select(F.col("prompt_id").alias("clarifying_prompt_id"), norm.alias("clar_norm"), F.col("content").alias("clar_content"), F.col("turn_index").alias("clar_turn"))
    return pairs.join(orig, "originating_prompt_id").join(clar, "clarifying_prompt_id")


def high_confidence(pairs: DataFrame) -> DataFrame:
    """JN5: rule and llm rows of one origin and kind; the confidence is the lesser one, null if either is."""
    rule = by_method(pairs, "rule").select("originating_prompt_id", "clarification_kind", F.col("pair_id").alias("rule_pair_id"), F.col("confidence").alias("c1"))
    llm = by_method(pairs, "llm").select("originating_prompt_id", "clarification_kind", F.col("pair_id").alias("llm_pair_id"), F.col("confidence").alias("c2"))
    both = F.col("c1").isNotNull() & F.col("c2").isNotNull()
    return rule.join(llm, ["originating_prompt_id", "clarification_kind"]).select(
        "rule_pair_id", "llm_pair_id", "originating_prompt_id", "clarification_kind", F.when(both, F.least("c1", "c2")).alias("confidence")
    )


def best_rule(pairs: DataFrame) -> DataFrame:
    """JN12: of each (origin, clarifier) the rule rows of greatest confidence; ties all stay."""
    rule = by_method(pairs, "rule").select("originating_prompt_id", "clarifying_prompt_id", F.col("clarification_kind").alias("rule_kind"), F.col("clarification_text").alias("rule_text"), "confidence")
    most = rule.groupBy("originating_prompt_id", "clarifying_prompt_id").agg(F.max("confidence").alias("most"))
    return rule.join(most, ["originating_prompt_id", "clarifying_prompt_id"]).filter("confidence = most").drop("confidence", "most")


def unlabeled_pairs(pairs: DataFrame, prompts: DataFrame, projects: DataFrame, own: str = OWN_TOOL) -> DataFrame:
    """LAB5, JN11, JN16, WIN1, AGG13: the best llm row of each content-equivalent group that has no manual label."""
    rows = with_contents(by_method(pairs, "llm"), prompts)
    best = Window.partitionBy(*CONTENT_KEY).orderBy(F.desc_nulls_last("confidence"), "pair_id")
    group = Window.partitionBy(*CONTENT_KEY)
    rows = rows.withColumns(
        {
            "rn": F.row_number().over(best),
            "duplicate_count": F.count("*").over(group),
            "all_llm_kinds": F.array_join(F.array_sort(F.collect_set("clarification_kind").over(group)), ","),
        }
    ).filter("rn = 1")
    done = with_contents(by_method(pairs, "manual"), prompts).select(*CONTENT_KEY).distinct()
    rows = rows.join(done, CONTENT_KEY, "left_anti").join(projects.select("project_id", "name", "cwd"), "project_id").filter(foreign_project(F.col("name"), F.col("cwd"), own))
    rows = rows.join(best_rule(pairs), ["originating_prompt_id", "clarifying_prompt_id"], "left")
    return rows.select("pair_id", "session_id", "clarification_kind", "confidence", "rule_kind", "rule_text", "name", "all_llm_kinds", "duplicate_count", "orig_turn", "clar_turn")


def wide_cases(pairs: DataFrame, prompts: DataFrame, projects: DataFrame, own: str = OWN_TOOL) -> DataFrame:
    """JN10, AGG16: of each origin and clarifier the first llm pair, unless a manual label has the same contents."""
    rows = with_contents(by_method(pairs, "llm"), prompts)
    done = with_contents(by_method(pairs, "manual"), prompts).select(*CONTENT_KEY).distinct()
    rows = rows.join(done, CONTENT_KEY, "left_anti").join(projects.select("project_id", "name", "cwd"), "project_id").filter(foreign_project(F.col("name"), F.col("cwd"), own))
    first = F.min_by(F.struct("session_id", "pair_id", "clarification_kind", "clarification_text"), "pair_id").alias("p")
    return rows.groupBy("originating_prompt_id", "clarifying_prompt_id").agg(first).select("p.*")


def retry_missing(pairs: DataFrame) -> DataFrame:
    """JN15: rule pairs whose origin has no llm row at all."""
    return by_method(pairs, "rule").join(by_method(pairs, "llm").select("originating_prompt_id").distinct(), "originating_prompt_id", "left_anti").select("pair_id", "originating_prompt_id", "clarifying_prompt_id")


def gold_progress(pairs: DataFrame, prompts: DataFrame, projects: DataFrame, version: str, own: str = OWN_TOOL) -> DataFrame:
    """AGG14-15: labelled, accepted, rejected, remaining and total, each content-equivalent group once. The total keeps
    the separator's collisions: its key is the three parts joined by a bar."""
    ok = projects.filter(foreign_project(F.col("name"), F.col("cwd"), own)).select("project_id")
    llm = with_contents(by_method(pairs, "llm"), prompts).join(ok, "project_id", "left_semi")
    pool = llm.agg(F.countDistinct(F.concat_ws("|", F.col("session_id").cast("string"), "orig_norm", "clar_norm")).alias("gold_total"))
    manual = with_contents(by_method(pairs, "manual").filter(F.col("extractor_version") == version), prompts).join(ok, "project_id", "left_semi")
    kind = manual.groupBy(*CONTENT_KEY).agg(F.max("clarification_kind").alias("kind"))
    counts = kind.agg(F.count("*").alias("total"), F.count("kind").alias("accepted"), F.count(F.when(F.col("kind").isNull(), 1)).alias("rejected"))
    return counts.crossJoin(pool).select("total", "accepted", "rejected", (F.col("gold_total") - F.col("total")).alias("remaining"), "gold_total")


def backfill_rows(pairs: DataFrame) -> DataFrame:
    """JN13, AGG12, FLT13: llm rows without a reason, with the greatest kind and text of the matching rule rows."""
    key = ["originating_prompt_id", "clarifying_prompt_id"]
    rule = by_method(pairs, "rule").groupBy(*key).agg(F.max("clarification_kind").alias("rule_kind"), F.max("clarification_text").alias("rule_text"))
    rows = by_method(pairs, "llm").filter("reason IS NULL OR reason = ''")
    return rows.join(rule, key, "left").select("pair_id", "rule_kind", "rule_text")


def with_reasons(pairs: DataFrame, reasons: DataFrame) -> DataFrame:
    """SNK11, LAB4: reasons by pair_id replace those of the pairs."""
    new = reasons.select("pair_id", F.col("reason").alias("__reason"))
    return pairs.join(new, "pair_id", "left").withColumn("reason", F.coalesce("__reason", "reason")).drop("__reason")


def pair_context(pairs: DataFrame, prompts: DataFrame, lookback: int = 5) -> DataFrame:
    """FLT14: the turns from lookback before a pair's origin to its clarifier. A range within one session."""
    own = with_contents(pairs, prompts).select("pair_id", "session_id", F.greatest(F.lit(0), F.col("orig_turn") - lookback).alias("lo"), F.col("clar_turn").alias("hi"))
    turns = prompts.select(F.col("session_id").alias("s"), "prompt_id", "turn_index", "role")
    return own.join(turns, (F.col("session_id") == F.col("s")) & F.col("turn_index").between(F.col("lo"), F.col("hi"))).select("pair_id", "prompt_id", "turn_index", "role")


def with_method_rows(pairs: DataFrame, new: DataFrame, method: str, version: str) -> DataFrame:
    """SNK7-8: rows of a method and version are replaced by the new ones."""
    return pairs.filter(~((F.col("extraction_method") == method) & F.col("extractor_version").eqNullSafe(F.lit(version)))).unionByName(new)


def balanced_sample(pairs: DataFrame, prompts: DataFrame, per_project: int, top: int = 2, seed: str = "pairs-1") -> DataFrame:
    """SRT9: so many rule pairs of each of the projects that have most of them, in hash order."""
    rule = by_method(pairs, "rule").join(prompts.select(F.col("prompt_id").alias("originating_prompt_id"), "project_id"), "originating_prompt_id")
    best = rule.groupBy("project_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "project_id").limit(top).select("project_id")
    order = Window.partitionBy("project_id").orderBy(F.md5(F.concat_ws(":", F.col("pair_id").cast("string"), F.lit(seed))), "pair_id")
    return rule.join(F.broadcast(best), "project_id").withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= per_project).select("project_id", "pair_id")
