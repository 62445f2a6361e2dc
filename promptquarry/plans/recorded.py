"""Recorded inputs of the registered queries, derived from the corpus by fixed rules: transcript and audit lines, verdicts,
decisions, answers. plans/oracles_io.py states the same rules in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUDGET_USD = 2.0
TOOLS = ("Edit", "Read", "Bash", "WebSearch")
END = "2025-02-01T00:00:00Z"


def _json(text: Column) -> Column:
    """A string as JSON."""
    listed = F.to_json(F.array(text))
    return F.substr(listed, F.lit(2), F.length(listed) - 2)


def _field(name: str, value: Column) -> Column:
    ""","name":value, or nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f',"{name}":'), value), F.lit(""))


def _two(number: Column) -> Column:
    return F.lpad(number.cast("string"), 2, "0")


def transcript_lines(turns: DataFrame) -> DataFrame:
    """conv_id, turn, line: one message of a transcript per turn."""
    c, t, role = F.col("conv_id"), F.col("turn"), F.col("role")
    text = F.when((role == "user") & (c % 12 == 5), F.concat(F.lit('<scheduled-task name="job-'), (c % 3).cast("string"), F.lit('">'), F.col("text"))).otherwise(F.col("text"))
    tool = F.element_at(F.array(*[F.lit(x) for x in TOOLS]), (F.floor(t / 2) % 4 + 1).cast("int"))
    used = F.concat(F.lit(',{"type":"tool_use","name":"'), tool, F.lit('","input":{"file_path":"src/'), (c % 7).cast("string"), F.lit('.py"}}'))
    blocks = F.concat(F.lit('[{"type":"thinking","thinking":"hm"},{"type":"text","text":'), _json(text), F.lit("}"), F.when(role == "assistant", used).otherwise(""), F.lit("]"))
    content = (
        F.when((role == "user") & ((c * 3 + t) % 8 == 0), F.lit('[{"type":"tool_result","content":"out"}]'))
        .when(t % 2 == 0, _json(text))
        .otherwise(blocks)
    )
    at = F.when(c % 23 != 0, F.concat(F.lit('"2025-01-'), _two(c % 28 + 1), F.lit("T08:"), _two(t % 60), F.lit(':00Z"')))
    line = F.concat(
        F.lit('{"type":"'), role, F.lit('"'), _field("isReplay", F.when((c + t) % 17 == 0, F.lit("true"))), _field("timestamp", at),
        _field("sessionId", F.concat(F.lit('"sess-'), c.cast("string"), F.lit('"'))),
        _field("cwd", F.when(t % 4 == 1, F.concat(F.lit('"/home/dev/p'), (c % 5).cast("string"), F.lit("/t"), t.cast("string"), F.lit('"')))),
        _field("version", F.when(t % 5 == 2, F.concat(F.lit('"1.'), t.cast("string"), F.lit('"')))),
        _field("userType", F.when(c % 14 == 7, F.lit('"internal"')).when(c % 2 == 0, F.lit('"external"'))),
        F.lit(',"message":{"role":"'), role, F.lit('","content":'), content, F.lit("}}"),
    )
    return turns.select("conv_id", "turn", line.alias("line"))


def transcript_rows(turns: DataFrame) -> DataFrame:
    """file, line_no, line: a transcript per conversation, some with broken lines before and a system event behind."""
    c = F.col("conv_id")
    named = lambda rows, n, line: rows.select(c.alias("file"), n.cast("long").alias("line_no"), line.alias("line"))
    own = named(transcript_lines(turns), F.col("turn"), F.col("line"))
    every = turns.select("conv_id").distinct()
    before = every.filter(c % 9 == 0).select("conv_id", F.posexplode(F.array(F.lit(""), F.lit("{broken"), F.lit("null"))).alias("i", "line"))
    behind = named(every.filter(c % 6 == 0), F.lit(2**62), F.concat(F.lit(f'{{"type":"system","timestamp":"{END}","sessionId":"sess-'), c.cast("string"), F.lit('"}')))
    return own.unionByName(named(before, F.col("i") - 2**62, F.col("line"))).unionByName(behind)


def audit_lines(turns: DataFrame) -> DataFrame:
    """path, line_no, line: the audit of a conversation."""
    c, t = F.col("conv_id"), F.col("turn")
    own = F.when(t % 2 == 0, F.concat(F.lit('"2025-03-'), _two(c % 28 + 1), F.lit("T08:"), _two(t % 60), F.lit(':00Z"')))
    other = F.concat(F.lit('"2025-04-'), _two(c % 28 + 1), F.lit("T08:"), _two(t % 60), F.lit(':00Z"'))
    line = F.concat(
        F.lit('{"type":"'), F.col("role"), F.lit('"'), _field("isReplay", F.when((c + t) % 17 == 0, F.lit("true"))), _field("_audit_timestamp", own), _field("timestamp", other),
        F.lit(',"message":{"role":"'), F.col("role"), F.lit('","content":'), _json(F.col("text")), F.lit("}}"),
    )
    return turns.select(F.concat(F.lit("file:/audits/a/b/local_"), c.cast("string"), F.lit("/audit.jsonl")).alias("path"), t.cast("int").alias("line_no"), line.alias("line"))


def manifests(turns: DataFrame) -> DataFrame:
    """path, value: a manifest for two thirds of the conversations, some of them broken."""
    c = F.col("conv_id")
    value = F.concat(
        F.lit('{"sessionId":"w-'), c.cast("string"), F.lit('","title":"Test: Feature  '), (c % 4).cast("string"), F.lit('","cwd":"/vm","model":"m1"'),
        _field("scheduledTaskId", F.when(c % 8 == 0, F.lit('"night"'))), F.lit("}"),
    )
    path = F.concat(F.lit("file:/audits/a/b/local_"), c.cast("string"), F.lit(".json"))
    return turns.select("conv_id").distinct().filter("conv_id % 3 <> 0").select(path.alias("path"), F.when(c % 10 == 0, F.lit("{broken")).otherwise(value).alias("value"))


def verdicts(pairs: DataFrame) -> DataFrame:
    """A verdict per rule pair: accepted, rejected or failed."""
    b = F.floor(F.col("pair_id") / 10)
    nothing = F.lit(None)
    return pairs.select(
        "pair_id", F.when(b % 9 > 1, b % 4 != 0).alias("accepted"), F.when(b % 5 == 0, "other").when(b % 13 == 0, "").otherwise(F.col("clarification_kind")).alias("kind"),
        F.when(b % 11 == 0, "").otherwise(F.substring("clarification_text", 1, 50)).alias("text"), F.when(b % 6 != 0, (b % 10) / 10.0).alias("confidence"),
        F.concat(F.lit("r"), (b % 3).cast("string")).alias("reason"), F.when(b % 9 == 0, "RateLimit").when((b % 9 == 1) & (b % 2 == 1), "Overloaded").alias("error_class"),
        F.when(b % 9 == 0, 429).alias("error_status"), F.when(b % 9 == 0, "slow down").otherwise(nothing).alias("error_message"),
        (b % 1000).alias("fresh_tokens"), (b % 500).alias("cached_tokens"), (b % 50).alias("out_tokens"), (b % 100).alias("latency_ms"),
    )


def decisions(pairs: DataFrame) -> DataFrame:
    """A decision per pair."""
    b = F.floor(F.col("pair_id") / 10)
    names = F.array(*[F.lit(x) for x in ("accept", "edit", "fix-kind", "reject", "skip", "quit")])
    return pairs.select("pair_id", F.element_at(names, (b % 6 + 1).cast("int")).alias("action"), F.lit("other").alias("kind"), F.concat(F.lit("edited "), (b % 4).cast("string")).alias("text"), F.lit("no").alias("reason"))


def answers(cases: DataFrame) -> DataFrame:
    """A generator's answer per case (as prompt_id)."""
    k = F.col("case_id")
    q = lambda text, kind, confidence: F.struct(text.alias("text"), F.lit(kind).alias("kind"), confidence.cast("double").alias("confidence"))
    gold = F.coalesce("gold_text", F.lit("nothing"))
    some = F.array(
        F.when(k % 2 == 1, q(F.concat(F.lit("does 'it' mean "), F.substring(gold, 1, 30)), "file-scope", (k % 10) / 10.0)),
        F.when(k % 3 != 0, q(F.concat(F.lit("live on production or local src/ "), F.substring("prompt", 1, 40)), "success-criteria", F.lit(0.5))),
        F.when(k % 4 != 0, q(gold, "constraint", (k % 7) / 10.0)),
    )
    failed = k % 19 == 0
    return cases.select(
        k.alias("prompt_id"), F.when(~failed, F.filter(some, lambda x: x.isNotNull())).alias("questions"), F.when(failed, "RateLimit").alias("error_class"),
        (F.length("prompt") * 10).alias("fresh_tokens"), (k % 1000).alias("cached_tokens"), (3000 + k % 7 * 100).alias("out_tokens"), (k % 500).alias("latency_ms"),
    )


def clarify_answers(prompts: DataFrame) -> DataFrame:
    """An answer, a skip or a failure per prompt."""
    k = F.col("prompt_id")
    q = lambda x: F.struct(F.lit(x).alias("text"), F.lit("other").alias("kind"), F.lit(0.5).alias("confidence"))
    found = F.when(k % 4 == 1, F.when(k % 8 == 1, F.array(q("a?"))).otherwise(F.array(q("a?"), q("b?"))))
    return prompts.select(
        "prompt_id", found.alias("questions"), F.when(k % 5 == 0, "Timeout").alias("error_class"), F.when(k % 10 == 0, 504).alias("error_status"),
        F.when(k % 5 == 0, F.concat(F.lit("late "), F.col("content"))).alias("error_message"), F.when(k % 4 != 1, "clear").alias("skip_reason"),
    )
