"""A stored corpus that transcripts are ingested into again and again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store
from .transcripts import TURN_BITS, merged_sessions


def merged_into(spark: SparkSession, root: str, new: dict[str, DataFrame]) -> store.Version:
    """SNK1-SNK3, ING1: a new version in which the sessions of new (tables as of transcripts.ingest) are written again. A
    session's prompts and tool calls are replaced by its new ones, also where it has none any more; a session seen before
    keeps its first values; a project keeps its first name and folder and takes the last time. New prompts get ids above all
    that are there. Only parts that hold one of these sessions or projects are read and written."""
    base = store.read_version(spark, root)
    sessions = store.kept(new["sessions"], "new-sessions")
    ids = sessions.select("session_id").distinct()
    last = 0
    if "prompts" in base.tables:
        last = store.read_parts(spark, root, base.tables["prompts"]).agg(F.max(F.shiftright("prompt_id", TURN_BITS))).first()[0] or 0
    above = F.lit(last << TURN_BITS)
    prompts = new["prompts"].withColumn("prompt_id", F.col("prompt_id") + above)
    calls = new["tool_calls"].withColumn("prompt_id", F.col("prompt_id") + above).withColumn("tool_call_id", F.struct("prompt_id", F.col("tool_call_id.i").alias("i")))

    def part(name: str, rows: DataFrame, merge) -> dict:
        entry = base.tables.get(name)
        if entry is None:
            return store.write_parts(rows, name, root)
        keys = ids if store.KEYS[name] == "session_id" else rows
        touched = [str(r[0]) for r in keys.select(store.part_of(name, keys.columns)).distinct().collect()]
        written = store.write_parts(merge(store.read_parts(spark, root, entry, touched), rows), name, root)
        return {"schema": written["schema"], "parts": {p: f for p, f in entry["parts"].items() if p not in touched} | written["parts"]}

    replaced = lambda old, rows: old.join(ids, "session_id", "left_anti").unionByName(rows)
    tables = {
        "sessions": part("sessions", sessions, merged_sessions),
        "prompts": part("prompts", prompts, replaced),
        "tool_calls": part("tool_calls", calls, replaced),
        "projects": part("projects", new["projects"], _merged_projects),
    }
    return store.commit(spark, root, base, tables)


def _merged_projects(old: DataFrame, new: DataFrame) -> DataFrame:
    both = old.withColumn("__seq", F.lit(0)).unionByName(new.withColumn("__seq", F.lit(1)))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("__seq"))).alias(c)
    return both.groupBy("project_id").agg(first("cwd"), first("name"), F.max_by("last_seen_at", F.when(F.col("last_seen_at").isNotNull(), F.col("__seq"))).alias("last_seen_at")).select(*old.columns)
