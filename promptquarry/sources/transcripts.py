"""Transcripts: JSON lines of two layouts to sessions, prompts and tool calls.

Files are read line by line and split like any text, so a file may be far larger than a task. The order of its lines is
part of the data: it is that of the blocks of the file and, inside a block, of the lines as they are read. Turns are
numbered inside blocks, and counts of the blocks before are added. JSON is kept as VARIANT up to the point where a
field is taken from it.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .store import kept

# fixed values: layouts of the two sources
PROJECTS, AUDITS = "claude-code", "cowork"
MODEL_PREFIX = "claude-code-"
TURN_BITS = 24

def _no_lines(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "path string, block long, line_no long, raw string").select("path", "block", "line_no", F.try_parse_json("raw").alias("v"))


def read_lines(spark: SparkSession, root: str, pattern: str = "*.jsonl") -> DataFrame:
    """SRC1, SRC2, SRC4: path, block, line_no, v of the lines that parse, of all files below root; a missing root is empty.
    block is where a task's part of the file begins, line_no orders the lines of a block; both together order a file's."""
    try:
        lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).option("lineSep", "\n").text(root)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e.getCondition()):
            raise
        return _no_lines(spark)
    rows = lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line_no"), "value")
    return _parsed(rows)


def _parsed(rows: DataFrame) -> DataFrame:
    parsed = rows.select("path", "block", "line_no", F.try_parse_json("value").alias("v"))
    return parsed.filter(F.col("v").isNotNull() & F.schema_of_variant("v").startswith("OBJECT"))


def write_bundles(lines: DataFrame, root: str) -> None:
    """Writes the lines (path, line_no, line) of many transcripts to few files: each line behind its transcript's path and a
    tab, those of a transcript in order and one file. So the number of files follows the size, not the number of transcripts."""
    dealt = lines.repartition("path").sortWithinPartitions("path", "line_no")
    dealt.select(F.concat("path", F.lit("\t"), "line").alias("value")).write.option("lineSep", "\n").text(root)


def read_bundles(spark: SparkSession, root: str, pattern: str = "*.txt") -> DataFrame:
    """As read_lines, of files as of write_bundles."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).option("lineSep", "\n").text(root)
    path, value = F.substring_index("value", "\t", 1), F.substr("value", F.instr("value", F.lit("\t")) + 1)
    return _parsed(lines.select(path.alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line_no"), value.alias("value")))


def read_manifests(spark: SparkSession, root: str) -> DataFrame:
    """SRC3: path of the folder that a manifest describes, and its fields; unreadable ones are left out."""
    try:
        files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "local_*.json").text(root, wholetext=True)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e.getCondition()):
            raise
        return spark.createDataFrame([], "folder string, " + ", ".join(f"{c} string" for c in MANIFEST))
    return manifest_rows(files.select(F.col("_metadata.file_path").alias("path"), "value"))


def manifest_rows(files: DataFrame) -> DataFrame:
    """Fields of manifest files (path, value); unreadable ones are left out."""
    v = files.select(F.regexp_replace("path", r"\.json$", "").alias("folder"), F.try_parse_json("value").alias("v")).filter("v IS NOT NULL")
    return v.select("folder", *[string_at("v", f"$.{c}").alias(c) for c in MANIFEST])


MANIFEST = ("sessionId", "cliSessionId", "cwd", "title", "model", "scheduledTaskId", "sessionType", "createdAt", "lastActivityAt", "isArchived")


def string_at(v: str, path: str) -> Column:
    """A string field; null for other types, which a plain cast would turn into their text."""
    found = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(found) == "STRING", F.try_variant_get(v, path, "string"))


def _blocks(content: Column) -> Column:
    is_list = F.schema_of_variant(content).startswith("ARRAY")
    return F.when(is_list, F.try_variant_get(content, "$", "array<variant>")).otherwise(F.array().cast("array<variant>"))


def human_text(content: Column) -> Column:
    """FLT3: a string as it is, of a list the text blocks; tool results, tool uses, thoughts and images are dropped."""
    is_text = lambda b: (F.try_variant_get(b, "$.type", "string") == "text") & (F.schema_of_variant(F.try_variant_get(b, "$.text", "variant")) == "STRING")
    joined = F.array_join(F.transform(F.filter(_blocks(content), is_text), lambda b: F.try_variant_get(b, "$.text", "string")), "\n")
    plain = F.when(F.schema_of_variant(content) == "STRING", F.try_variant_get(content, "$", "string"))
    return T.trimmed(F.coalesce(plain, joined, F.lit("")))


def has_tool_result(content: Column) -> Column:
    """FLT4."""
    return F.exists(_blocks(content), lambda b: F.coalesce(F.try_variant_get(b, "$.type", "string") == "tool_result", F.lit(False)))


def tool_uses(content: Column) -> Column:
    """SCL23: array<struct<tool_name, file_path, operation>> of a message's tool uses."""
    used = F.filter(_blocks(content), lambda b: F.coalesce(F.try_variant_get(b, "$.type", "string") == "tool_use", F.lit(False)))

    def one(b: Column) -> Column:
        name = F.coalesce(F.try_variant_get(b, "$.name", "string"), F.lit("unknown"))
        path = F.coalesce(F.try_variant_get(b, "$.input.file_path", "string"), F.try_variant_get(b, "$.input.path", "string"))
        return F.struct(name.alias("tool_name"), path.alias("file_path"), T.tool_operation(name).alias("operation"))

    return F.transform(used, one)


def read_events(lines: DataFrame, audit: bool = False) -> DataFrame:
    """FLT2, FLT5: lines that are no replays, with time, kind, role, content and the fields that sessions and turns take.
    lines without a block are ordered by line_no alone."""
    lines = lines if "block" in lines.columns else lines.withColumn("block", F.lit(0).cast("long"))
    rows = lines.filter(~F.coalesce(F.try_variant_get("v", "$.isReplay", "boolean"), F.lit(False)))
    at = T.iso_time(F.try_variant_get("v", "$.timestamp", "variant"))
    if audit:
        at = F.coalesce(T.iso_time(F.try_variant_get("v", "$._audit_timestamp", "variant")), at)
    kind = string_at("v", "$.type")
    message = F.try_variant_get("v", "$.message.content", "variant")
    has_message = F.try_variant_get("v", "$.message", "variant").isNotNull()
    role = F.when(kind.isin("user", "assistant") & has_message, F.when(string_at("v", "$.message.role") == "assistant", "assistant").otherwise("user"))
    rows = rows.select("path", "block", "line_no", "v", at.alias("at"), kind.alias("kind"), role.alias("role"), message.alias("message"), human_text(message).alias("content"))
    is_turn = F.coalesce((F.col("role") == "assistant") | ((F.col("role") == "user") & (F.col("content") != "")), F.lit(False))
    queued = F.when((F.col("kind") == "queue-operation") & (string_at("v", "$.operation") == "enqueue"), string_at("v", "$.content"))
    named = {name: string_at("v", f"$.{field}") for name, field in FIELDS.items()}
    return rows.withColumns(named | {"queued": queued, "is_turn": is_turn, "raw": F.when(is_turn, F.to_json("v")), "uses": F.when(F.col("role") == "assistant", tool_uses(F.col("message")))})


#: Fields of a line that sessions take.
FIELDS = {"session_key": "sessionId", "cwd": "cwd", "git_branch": "gitBranch", "user_type": "userType", "version": "version"}
_ORDER = ("block", "line_no")


def _first(value: Column) -> Column:
    return F.min_by(value, F.when(value.isNotNull(), F.struct(*_ORDER)))


def _last(value: Column) -> Column:
    return F.max_by(value, F.when(value.isNotNull(), F.struct(*_ORDER)))


def sessions_of_projects(events: DataFrame) -> DataFrame:
    """SRC5, AGG23: first and last by the order in the file. A file without any time has no session."""
    user = F.when((F.col("role") == "user") & (F.col("content") != ""), F.col("content"))
    rows = events.groupBy("path").agg(
        *[_last(F.col(c)).alias(c) for c in ("session_key", "cwd", "git_branch", "user_type")], _first(F.col("version")).alias("version"), _first(F.col("at")).alias("started_at"),
        _last(F.col("at")).alias("ended_at"), F.coalesce(_first(user), _first(F.col("queued")), F.lit("")).alias("first_text"),
    )
    base = F.regexp_extract("path", r"([^/]+)\.[a-z]+$", 1)
    return rows.filter("started_at IS NOT NULL").select(
        F.lit(PROJECTS).alias("source"), F.coalesce("session_key", base).alias("session_id"), F.col("path").alias("source_path"), "cwd", "started_at", "ended_at",
        F.lit(None).cast("string").alias("title"), F.concat(F.lit(MODEL_PREFIX), "version").alias("model"), "git_branch",
        T.scheduled_task(F.col("first_text")).alias("scheduled_task_id"), "user_type", "path",
    )


def sessions_of_audits(events: DataFrame, manifests: DataFrame) -> DataFrame:
    """SRC6, JN20: the manifest beside the folder names the session; sessions without events are left out."""
    rows = events.groupBy("path").agg(_first(F.col("at")).alias("first_at"), _last(F.col("at")).alias("last_at"))
    rows = rows.withColumn("folder", F.regexp_replace("path", r"/[^/]*$", "")).join(manifests, "folder", "left")
    scheduled = F.nullif(F.col("scheduledTaskId"), F.lit(""))
    base = F.regexp_extract("folder", r"([^/]+)$", 1)
    return rows.select(
        F.lit(AUDITS).alias("source"), F.coalesce(F.nullif("sessionId", F.lit("")), base).alias("session_id"), F.col("folder").alias("source_path"), "cwd",
        F.coalesce("first_at", "createdAt").alias("started_at"), F.coalesce("last_at", "lastActivityAt").alias("ended_at"), "title", "model",
        F.lit(None).cast("string").alias("git_branch"), scheduled.alias("scheduled_task_id"), F.when(scheduled.isNotNull(), "scheduled").otherwise("external").alias("user_type"), "path",
    )


def with_projects(sessions: DataFrame) -> DataFrame:
    """Project key and name, eligibility."""
    args = [F.col(c) for c in ("title", "cwd", "scheduled_task_id")]
    return sessions.withColumns({
        "project_id": T.project_id(F.col("source"), F.col("session_id"), *args), "project_name": T.project_name(*args),
        "eligible": T.eligible(F.col("scheduled_task_id"), F.col("user_type")),
    })


def numbered_files(sessions: DataFrame) -> DataFrame:
    """SRT10: sessions with file_no, their number in the order of source, folder and path: the files before their folder,
    and their place in it. Only one row per folder is put in order as a whole."""
    rows = sessions.withColumn("__folder", F.regexp_extract("path", r"^(.*/)[^/]*$", 1))
    before = Window.orderBy("source", "__folder").rowsBetween(Window.unboundedPreceding, -1)
    folders = rows.groupBy("source", "__folder").agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    inside = F.row_number().over(Window.partitionBy("source", "__folder").orderBy("path"))
    rows = rows.withColumn("__nth", inside).join(folders, ["source", "__folder"])
    return rows.withColumn("file_no", (F.col("__before") + F.col("__nth")).cast("long")).drop("__folder", "__before", "__nth")


def numbered_turns(events: DataFrame) -> DataFrame:
    """WIN5: the turns of a file with turn_index: their place in the block, after the turns of the file's blocks before. So no
    task needs all turns of a file."""
    turns = events.filter("is_turn")
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = turns.groupBy("path", "block").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = F.row_number().over(Window.partitionBy("path", "block").orderBy("line_no")) - 1
    return turns.withColumn("turn_index", inside).join(blocks, ["path", "block"]).withColumn("turn_index", (F.col("turn_index") + F.col("before")).cast("long")).drop("before")


def prompts_of(events: DataFrame, sessions: DataFrame) -> DataFrame:
    """WIN5: the turns. A user message without human text is none; an assistant's always is one. Ids follow the order
    of source, folder, file and turn. sessions with file_no."""
    rows = numbered_turns(events).join(sessions.select("path", "session_id", "project_id", "eligible", "file_no"), "path")
    normal = T.normalized(F.col("content"))
    tags = T.prompt_tags(F.col("content"))
    return rows.select(
        (F.shiftleft("file_no", TURN_BITS) + F.col("turn_index")).alias("prompt_id"), "session_id", "project_id", "turn_index", "role", "content", normal.alias("normalized_content"),
        F.col("raw").alias("raw_event_json"), F.col("at").alias("timestamp"), *[tags[f"has_{k}"].alias(f"has_{k}") for k in ("files", "tests", "criteria", "constraints", "local_env")],
        "eligible", "uses",
    )


def tool_calls_of(prompts: DataFrame) -> DataFrame:
    """JN24: tool uses with the turn that made them."""
    rows = prompts.filter("role = 'assistant'").select("prompt_id", "session_id", "timestamp", F.posexplode("uses").alias("i", "u"))
    return rows.select(F.struct("prompt_id", "i").alias("tool_call_id"), "prompt_id", "session_id", "u.tool_name", "u.file_path", "u.operation", F.lit(None).cast("boolean").alias("success"), "timestamp")


def ingest(spark: SparkSession, projects_root: str | None = None, audits_root: str | None = None, pattern: str = "*.jsonl", bundled: bool = False) -> dict[str, DataFrame]:
    """ING1, SET5: sessions, prompts, tool_calls and projects of both sources; without a root they are empty. Files are
    parsed once: their events and sessions are kept as tables that all others are made of. bundled: the projects' transcripts
    lie in files as of write_bundles."""
    read = read_bundles if bundled else read_lines
    own = read_events(read(spark, projects_root, pattern) if projects_root else _no_lines(spark))
    audits = read_events(read_lines(spark, audits_root, "audit.jsonl") if audits_root else _no_lines(spark), audit=True)
    events = own.withColumn("is_audit", F.lit(False)).unionByName(audits.withColumn("is_audit", F.lit(True)))
    events = kept(events.drop("v", "message"), "transcript-events")
    manifests = read_manifests(spark, audits_root) if audits_root else spark.createDataFrame([], "folder string, " + ", ".join(f"{c} string" for c in MANIFEST))
    sessions = sessions_of_projects(events.filter("NOT is_audit")).unionByName(sessions_of_audits(events.filter("is_audit"), manifests))
    return corpus_of(events, kept(numbered_files(with_projects(sessions)), "transcript-sessions"))


def corpus_of(events: DataFrame, sessions: DataFrame) -> dict[str, DataFrame]:
    """The tables of numbered sessions and their events."""
    prompts = prompts_of(events, sessions)
    turns = events.filter("is_turn").groupBy("path").agg(F.count("*").alias("turns")).join(sessions.select("path", "session_id"), "path")
    turns = turns.groupBy("session_id").agg(F.sum("turns").alias("turn_count"))
    return {
        "sessions": sessions.join(turns, "session_id", "left").withColumn("turn_count", F.coalesce("turn_count", F.lit(0))).drop("path", "file_no"),
        "prompts": prompts.drop("uses"),
        "tool_calls": tool_calls_of(prompts),
        "projects": merged_projects(sessions.withColumn("seq", F.col("file_no"))),
    }


def merged_projects(sessions: DataFrame) -> DataFrame:
    """SNK2: name and folder are the first ones known, last_seen that of the session processed last. sessions with seq."""
    some = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    return sessions.groupBy("project_id").agg(some("cwd"), some("project_name"), F.max_by(F.coalesce("ended_at", "started_at"), "seq").alias("last_seen_at")).withColumnRenamed("project_name", "name")


KEPT_FIRST = ("project_id", "cwd", "started_at", "model", "source_path")


def merged_sessions(existing: DataFrame, new: DataFrame) -> DataFrame:
    """SNK3: a session seen again keeps its first project, folder, start, model and path; the rest is renewed."""
    both = existing.withColumn("__seq", F.lit(0)).unionByName(new.withColumn("__seq", F.lit(1)))
    columns = [c for c in existing.columns if c != "session_id"]
    pick = lambda c: (F.min_by if c in KEPT_FIRST else F.max_by)(c, "__seq").alias(c)
    return both.groupBy("session_id").agg(*[pick(c) for c in columns]).select(*existing.columns)


def replaced_rows(existing: DataFrame, new: DataFrame) -> DataFrame:
    """SNK1: rows of sessions that are written again are replaced."""
    return existing.join(new.select("session_id").distinct(), "session_id", "left_anti").unionByName(new)
