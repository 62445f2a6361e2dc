"""Reports over the corpus tables: each a small grouped aggregation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import kept


def _n(condition, name: str):
    return F.sum(F.when(condition, 1).otherwise(0)).cast("long").alias(name)


def source_counts(sessions: DataFrame, prompts: DataFrame) -> DataFrame:
    """AGG1: sessions and events per source."""
    per = prompts.groupBy("session_id").agg(F.count("*").alias("events"))
    return sessions.join(per, "session_id", "left").groupBy("source").agg(F.count("*").alias("sessions"), F.coalesce(F.sum("events"), F.lit(0)).cast("long").alias("events"))


def session_eligibility(sessions: DataFrame) -> DataFrame:
    """AGG2; sums over no rows are null."""
    scheduled = F.col("scheduled_task_id").isNotNull()
    inside = F.col("user_type").isNotNull() & (F.col("user_type") != "external") & ~scheduled
    return sessions.agg(F.count("*").alias("total"), _n(F.col("eligible"), "eligible"), _n(~F.col("eligible"), "excluded"), _n(scheduled, "scheduled"), _n(inside, "non_external"))


def top_projects(projects: DataFrame, sessions: DataFrame, prompts: DataFrame, top: int = 5) -> DataFrame:
    """AGG3, JN6, SRT2. Counts per session first, so that prompts are shuffled once as light rows."""
    per = prompts.groupBy("session_id").agg(_n(F.col("role") == "user", "users"))
    rows = sessions.filter("eligible").join(per, "session_id").groupBy("project_id").agg(F.sum("users").alias("user_prompt_count"), F.count("*").alias("session_count"))
    return projects.join(rows, "project_id").select("project_id", "name", "user_prompt_count", "session_count").orderBy(F.desc("user_prompt_count"), "project_id").limit(top)


def role_counts(sessions: DataFrame, prompts: DataFrame) -> DataFrame:
    """AGG4."""
    rows = prompts.select("session_id", "role").join(sessions.select("session_id", "eligible"), "session_id")
    return rows.groupBy("role").agg(F.count("*").alias("total"), _n(F.col("eligible"), "eligible"))


def operation_histogram(tool_calls: DataFrame, top: int = 10) -> DataFrame:
    """AGG5, SRT2."""
    return tool_calls.groupBy("operation").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "operation").limit(top)


def snapshot_totals(snapshots: DataFrame, files: DataFrame) -> DataFrame:
    """AGG6: snapshots, files and bytes by type."""
    per = files.groupBy("snapshot_id").agg(F.count("*").alias("file_count"), F.sum("size_bytes").alias("total_bytes"))
    return snapshots.join(per, "snapshot_id").groupBy("snapshot_type").agg(F.count("*").alias("snapshots"), F.sum("file_count").alias("files"), F.sum("total_bytes").alias("bytes"))


def outcome_histogram(outcomes: DataFrame) -> DataFrame:
    """AGG7."""
    return outcomes.groupBy("outcome").agg(F.count("*").alias("n"))


def pair_density(pairs: DataFrame, prompts: DataFrame, projects: DataFrame) -> DataFrame:
    """AGG8, JN7: pairs, distinct kinds and sessions per project."""
    own = pairs.join(prompts.select(F.col("prompt_id").alias("originating_prompt_id"), "project_id"), "originating_prompt_id")
    counts = own.groupBy("project_id").agg(F.count("*").alias("pairs"), F.countDistinct("clarification_kind").alias("kinds"), F.countDistinct("session_id").alias("sessions"))
    return counts.join(projects.select("project_id", "name"), "project_id").select("project_id", "name", "pairs", "kinds", "sessions")


def kind_histogram(pairs: DataFrame) -> DataFrame:
    """AGG9."""
    return pairs.groupBy("clarification_kind").agg(F.count("*").alias("n"))


def random_prompts(prompts: DataFrame, per_project: int, seed: str = "sample-1") -> DataFrame:
    """SRT3, SRT9, FLT10: so many eligible user prompts of each project, in the order of a hash of their id."""
    key = F.md5(F.concat_ws(":", F.col("prompt_id").cast("string"), F.lit(seed)))
    order = Window.partitionBy("project_id").orderBy(key, "prompt_id")
    rows = prompts.filter((F.col("role") == "user") & F.col("eligible") & (F.length("content") > 20))
    preview = F.substring(F.regexp_replace("content", "[ \\t\\n\\r]+", " "), 1, 200)
    return rows.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= per_project).select("project_id", "prompt_id", "session_id", "turn_index", preview.alias("preview"))


#: Of these sections of a report the keys with the greatest first metric are shown, so many.
REPORT_TOPS = {"projects": ("user_prompts", 5), "operations": ("calls", 10), "pairs": ("pairs", 10)}


def _facts(rows: DataFrame, *facts: tuple) -> DataFrame:
    """section, key, metric, value: one row for each fact (section, key, metric, value) of each row; a null value is no fact."""
    each = F.array(*[F.struct(F.lit(s).alias("section"), F.coalesce(k.cast("string"), F.lit("?")).alias("key"), F.lit(m).alias("metric"), v.cast("long").alias("value")) for s, k, m, v in facts])
    return rows.select(F.explode(each).alias("f")).select("f.*").filter("value IS NOT NULL")


def report(sessions: DataFrame, prompts: DataFrame, projects: DataFrame, tool_calls: DataFrame, snapshots: DataFrame, files: DataFrame, outcomes: DataFrame, pairs: DataFrame, tops: dict = REPORT_TOPS) -> DataFrame:
    """STA1: section, key, metric, value: all numbers of AGG1 to AGG9 at once. Every table is scanned once: prompts are counted
    per session and role, what is distinct is counted as rows of its own, and all facts are summed by section, key and
    metric together. pairs are those of one method; a pair has the project of its session."""
    one = F.lit(1)
    per = kept(prompts.groupBy("session_id", "role").agg(F.count("*").alias("n")), "prompts-per-session")
    counts = per.groupBy("session_id").agg(F.sum("n").alias("events"), F.sum(F.when(F.col("role") == "user", F.col("n")).otherwise(0)).alias("users"))
    known = projects.select("project_id", F.lit(True).alias("known"))
    own = sessions.join(counts, "session_id", "left").join(known, "project_id", "left")
    scheduled = F.col("scheduled_task_id").isNotNull()
    inside = F.col("user_type").isNotNull() & (F.col("user_type") != "external") & ~scheduled
    count = lambda condition: F.when(condition, 1).otherwise(0)
    every = F.lit("all")
    shown = F.col("eligible") & F.col("events").isNotNull() & F.col("known")
    about_sessions = _facts(
        own, ("sources", F.col("source"), "sessions", one), ("sources", F.col("source"), "events", F.coalesce("events", F.lit(0))), ("sessions", every, "total", one),
        ("sessions", every, "eligible", count(F.col("eligible"))), ("sessions", every, "excluded", count(~F.col("eligible"))), ("sessions", every, "scheduled", count(scheduled)),
        ("sessions", every, "non_external", count(inside)), ("projects", F.col("project_id"), "user_prompts", F.when(shown, F.col("users"))), ("projects", F.col("project_id"), "sessions", F.when(shown, 1)),
    )
    roles = per.join(sessions.select("session_id", "eligible"), "session_id")
    about_prompts = _facts(roles, ("roles", F.col("role"), "total", F.col("n")), ("roles", F.col("role"), "eligible", F.when(F.col("eligible"), F.col("n")).otherwise(0)))
    about_tools = _facts(tool_calls, ("tools", every, "calls", one), ("operations", F.col("operation"), "calls", one))
    sizes = files.groupBy("snapshot_id").agg(F.count("*").alias("n"), F.sum("size_bytes").alias("bytes"))
    kind = F.col("snapshot_type")
    about_snapshots = _facts(snapshots.join(sizes, "snapshot_id"), ("snapshots", kind, "snapshots", one), ("snapshots", kind, "files", F.col("n")), ("snapshots", kind, "bytes", F.col("bytes")))
    about_outcomes = _facts(outcomes, ("outcomes", F.col("outcome"), "sessions", one))
    paired = pairs.select("session_id", "clarification_kind").join(own.filter("known").select("session_id", "project_id"), "session_id", "left")
    whats = F.array(F.struct(F.lit("kinds").alias("what"), F.col("clarification_kind").cast("string").alias("of")), F.struct(F.lit("sessions").alias("what"), F.col("session_id").cast("string").alias("of")))
    distinct = paired.select("project_id", F.explode(whats).alias("w")).groupBy("project_id", "w").agg(F.count("*").alias("n"))
    what = F.col("w.what")
    project, some = F.col("project_id"), F.col("project_id").isNotNull() & F.col("w.of").isNotNull()
    about_pairs = _facts(
        distinct, ("kinds", F.col("w.of"), "pairs", F.when(what == "kinds", F.col("n"))), ("pairs", project, "pairs", F.when((what == "sessions") & some, F.col("n"))),
        ("pairs", project, "kinds", F.when((what == "kinds") & some, 1)), ("pairs", project, "sessions", F.when((what == "sessions") & some, 1)),
    )
    parts = (about_sessions, about_prompts, about_tools, about_snapshots, about_outcomes, about_pairs)
    totals = kept(reduce(DataFrame.unionByName, parts).groupBy("section", "key", "metric").agg(F.sum("value").alias("value")), "report")
    lead, most = (F.create_map(*[F.lit(x) for s, m in tops.items() for x in (s, m[i])]) for i in (0, 1))
    first = totals.filter(F.col("metric") == F.try_element_at(lead, F.col("section"))).withColumn("rn", F.row_number().over(Window.partitionBy("section").orderBy(F.desc("value"), "key")))
    first = first.filter(F.col("rn") <= F.try_element_at(most, F.col("section"))).select("section", "key")
    return totals.filter(~F.col("section").isin(*tops)).unionByName(totals.join(first, ["section", "key"]))
