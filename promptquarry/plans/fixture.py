"""The corpus that the registered queries run on, derived from `conversations` and `documents` by rules that Spark
and DuckDB state alike: suffixes by a bucket of the conversation and turn, replayed rows, sessions, projects,
snapshots of documents' lines, verdicts and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: By bucket; bucket 9 puts its text in front.
SUFFIXES = (
    "",
    " Please update src/auth/login.ts and utils/date.py",
    " It must handle 500 requests",
    " and never change the public API",
    " then verify with a spec",
    " using a schema with columns id and name",
    " with a bigger button colour",
    " see localhost:5432 and /home/dev/app/src/main.ts token=abc123",
    " see https://example.com/a?b=1 ```js let x``` and `inline` end",
    "",
    " and fix the build, make it work",
)
PREFIXES = ("Last login: today ", "TEST REPORT for ", "Here is the audit report: ", "I''m thinking ")

_BUCKET = "(conv_id * 7 + turn * 3) % 11"
_SUFFIX = "CASE " + _BUCKET + " " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(SUFFIXES)) + " END"
_PREFIX = f"CASE WHEN {_BUCKET} = 9 THEN CASE turn % 4 " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(PREFIXES)) + " END ELSE '' END"

#: Each view by name, in order; the text is valid for Spark and for DuckDB.
VIEWS = {
    "raw_turns": "SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, text FROM conversations WHERE role IN ('user', 'assistant')",
    "prompts": f"""
        SELECT conv_id * 1000 + turn + r AS prompt_id, conv_id AS session_id, conv_id % 5 AS project_id, turn AS turn_index, role,
               concat({_PREFIX}, text, {_SUFFIX}) AS content, conv_id % 7 <> 0 AS eligible
        FROM (SELECT *, 0 AS r FROM raw_turns UNION ALL SELECT *, 500 AS r FROM raw_turns WHERE role = 'user' AND (conv_id + turn) % 13 = 0) t""",
    "sessions": """
        SELECT session_id, session_id % 5 AS project_id,
               CASE session_id % 3 WHEN 0 THEN 'claude-code' WHEN 1 THEN 'cowork' ELSE 'manual' END AS source,
               CASE WHEN session_id % 14 = 0 THEN 'nightly' END AS scheduled_task_id,
               CASE WHEN session_id % 14 = 7 THEN 'internal' WHEN session_id % 4 = 1 THEN CAST(NULL AS STRING) ELSE 'external' END AS user_type,
               concat('2025-01-', CAST(10 + session_id % 20 AS STRING), 'T08:00:00Z') AS started_at,
               CASE WHEN session_id % 10 <> 0 THEN concat('2025-01-', CAST(10 + (session_id * 7) % 20 AS STRING), 'T09:30:00Z') END AS ended_at,
               concat('Test: Feature  ', CAST(session_id % 6 AS STRING)) AS title,
               CASE WHEN session_id % 6 <> 5 THEN concat('/home/dev/app', CAST(session_id % 8 AS STRING)) END AS cwd,
               session_id % 7 <> 0 AS eligible
        FROM (SELECT DISTINCT conv_id AS session_id FROM raw_turns) t""",
    "projects": """
        SELECT project_id, CASE WHEN project_id = 4 THEN 'own-tool' ELSE concat('project-', CAST(project_id AS STRING)) END AS name,
               CASE WHEN project_id <> 3 THEN concat('/home/dev/p', CAST(project_id AS STRING)) END AS cwd
        FROM (SELECT DISTINCT session_id % 5 AS project_id FROM sessions) t""",
}
_TABLES = ("conversations", "documents", "events")


def open_corpus(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The views as DataFrames, and the tables that they stand on."""
    out = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _TABLES}
    for name, text in VIEWS.items():
        out[name] = spark.sql(_named(text), **{k: v for k, v in out.items() if _uses(text, k)})
    return out


def _uses(text: str, name: str) -> bool:
    return f"FROM {name}" in text


def _named(text: str) -> str:
    for name in (*_TABLES, *VIEWS):
        text = text.replace(f"FROM {name} ", f"FROM {{{name}}} ").replace(f"FROM {name})", f"FROM {{{name}}})").replace(f"FROM {name}\n", f"FROM {{{name}}}\n")
        if text.endswith(f"FROM {name}"):
            text = text[: -len(name)] + f"{{{name}}}"
    return text


def with_views(query: str, *more: tuple[str, str]) -> str:
    """DuckDB: the query under the views and the further ones that it names."""
    parts = [f"{k} AS ({v})" for k, v in [*VIEWS.items(), *more]]
    return "WITH " + ",\n".join(parts) + "\n" + query
