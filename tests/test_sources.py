import gzip
import json

import pytest
from pyspark.sql import functions as F

from promptquarry.sources import config, snapshots, transcripts
from promptquarry.streaming import ingest as streaming


def lines(*rows):
    return "\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n"


def message(role, content, **more):
    return {"type": role, "message": {"role": role, "content": content}, **more}


@pytest.fixture
def roots(tmp_path):
    project = tmp_path / "projects" / "p"
    project.mkdir(parents=True)
    (project / "one.jsonl").write_text(
        lines(
            message("user", "first", timestamp="2025-01-01T00:00:00Z", isReplay=True),
            message("user", "Fix `x` in src/app/main.ts", timestamp="2025-01-02T00:00:00Z", sessionId="s1", cwd="/home/me/app", version="1.2", userType="external"),
            "", "{broken", "null",
            message("user", [{"type": "tool_result", "content": "out"}], timestamp=1735776000000),
            message("assistant", [{"type": "text", "text": "done"}, {"type": "thinking", "thinking": "hm"}, {"type": "tool_use", "name": "MultiEdit", "input": {"file_path": "a.py"}}, {"type": "tool_use", "name": "Glob", "input": {"path": "src"}}], timestamp="2025-01-02T00:01:00Z", version="1.3"),
            {"type": "system", "subtype": "x", "timestamp": "2025-01-01T12:00:00Z", "cwd": "/home/me/other"},
        )
    )
    (project / "two.jsonl").write_text(lines(message("user", '<scheduled-task name="nightly">go', timestamp=1735776000000)))
    (project / "none.jsonl").write_text(lines({"type": "user", "message": {"content": "no time"}}))
    audit = tmp_path / "audits" / "a" / "b" / "local_7"
    audit.mkdir(parents=True)
    (audit / "audit.jsonl").write_text(lines(message("user", "hello there", timestamp="2025-02-02T00:00:00Z", _audit_timestamp="2025-02-01T00:00:00Z")))
    (audit.parent / "local_7.json").write_text(json.dumps({"sessionId": "w7", "title": "Test: My  App", "cwd": "/vm", "model": "m"}))
    return str(tmp_path / "projects"), str(tmp_path / "audits")


def test_ingest(spark, roots):
    out = transcripts.ingest(spark, *roots)
    sessions = {r["session_id"]: r for r in out["sessions"].collect()}
    assert set(sessions) == {"s1", "two", "w7"}
    one = sessions["s1"]
    assert (one["started_at"], one["ended_at"]) == ("2025-01-02T00:00:00Z", "2025-01-01T12:00:00Z")  # by order in the file
    assert (one["cwd"], one["model"], one["eligible"], one["turn_count"]) == ("/home/me/other", "claude-code-1.2", True, 2)
    assert sessions["two"]["scheduled_task_id"] == "nightly" and not sessions["two"]["eligible"]
    assert sessions["two"]["started_at"] == "2025-01-02T00:00:00.000Z"
    assert sessions["w7"]["started_at"] == "2025-02-01T00:00:00Z" and sessions["w7"]["title"] == "Test: My  App"
    prompts = [r for r in out["prompts"].orderBy("prompt_id").collect() if r["session_id"] == "s1"]
    assert [(p["role"], p["content"], p["turn_index"]) for p in prompts] == [("user", "Fix `x` in src/app/main.ts", 0), ("assistant", "done", 1)]
    assert prompts[0]["has_files"] and prompts[0]["normalized_content"] == "fix in src/app/main.ts"
    calls = out["tool_calls"].orderBy("tool_call_id").collect()
    assert [(c["tool_name"], c["file_path"], c["operation"], c["prompt_id"]) for c in calls] == [("MultiEdit", "a.py", "edit", prompts[1]["prompt_id"]), ("Glob", "src", "glob", prompts[1]["prompt_id"])]
    assert {r["name"] for r in out["projects"].collect()} == {"other", "nightly", "Test: My  App"}


def test_missing_roots(spark, tmp_path):
    out = transcripts.ingest(spark, str(tmp_path / "no"), str(tmp_path / "nowhere"))
    assert out["sessions"].count() == 0 and out["prompts"].count() == 0


def test_merged_sessions(spark):
    old = spark.createDataFrame([("s", "p1", "2025", "t1")], "session_id string, project_id string, started_at string, title string")
    new = spark.createDataFrame([("s", "p2", "2026", "t2"), ("n", "p3", "2027", "t3")], old.schema)
    rows = {r["session_id"]: tuple(r)[1:] for r in transcripts.merged_sessions(old, new).collect()}
    assert rows == {"s": ("p1", "2025", "t2"), "n": ("p3", "2027", "t3")}
    assert transcripts.replaced_rows(old, new).count() == 2


def test_snapshots(spark, tmp_path):
    for name, text in (("a.py", "x" * 2000), ("b/c.py", "y"), ("b/d.py", "y"), ("node_modules/z.js", "no"), ("p.png", "no")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    files = snapshots.walk_files(spark, str(tmp_path))
    assert {r["relative_path"] for r in files.collect()} == {"a.py", "b/c.py", "b/d.py"}
    blobs = snapshots.new_blobs(files).collect()
    assert len(blobs) == 2 and gzip.decompress(next(b["content"] for b in blobs if b["is_compressed"])) == b"x" * 2000
    assert snapshots.new_blobs(files, snapshots.new_blobs(files)).count() == 0
    assert {r["project_id"] for r in snapshots.trash_folders(files).collect()} == {"trash:b"}
    assert snapshots.file_status(spark, str(tmp_path / "a.py"))["size"] == 2000
    assert not snapshots.file_status(spark, str(tmp_path / "gone"))["exists"]


def test_new_snapshots_are_null_safe(spark):
    rows = spark.createDataFrame([("p", "trash-snapshot", None, 1), ("q", "trash-snapshot", None, 1), ("e", "trash-snapshot", None, 0)], "source_path string, snapshot_type string, session_id string, file_count long")
    assert [r["source_path"] for r in snapshots.new_snapshots(rows, rows.filter("source_path = 'p'")).collect()] == ["q"]


def test_config(tmp_path, spark):
    (tmp_path / config.FILE_NAME).write_text('{"maxContextTokens": 9, "autoInject": false}')
    got = config.load_config(str(tmp_path), {"autoInject": True})
    assert got["maxContextTokens"] == 9 and got["autoInject"] is True and len(got["contextFiles"]) == 5
    (tmp_path / config.FILE_NAME).write_text("{broken")
    assert config.load_config(str(tmp_path)) == config.DEFAULTS
    (tmp_path / ".env").write_text("A=1\nexport B='two'\n# C=3\n")
    assert config.load_env(str(tmp_path / ".env"), {"A": "0", "B": ""}) == {"A": "0", "B": "two"}
    (tmp_path / "README.md").write_text("x" * 3000)
    row = config.load_context(spark, str(tmp_path)).first()
    assert (row["name"], row["position"], row["relevance"], len(row["content"])) == ("README.md", 4, 0.6, 2016)


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [{"uuid": u, "timestamp": f"2025-01-01T00:{m:02d}:00Z", "type": "user"} for u, m in (("a", 1), ("b", 2), ("a", 3))]
    (tmp_path / "in" / "x.jsonl").write_text(lines(*rows, "{broken"))
    seen = []
    streaming.run_available(streaming.stream_lines(spark, str(tmp_path / "in")), str(tmp_path / "cp"), lambda df, _: seen.extend(r["uuid"] for r in df.select("uuid").collect()))
    assert sorted(seen) == ["a", "b"]
    batch = spark.createDataFrame([("user", "2025-01-01 00:01:00"), ("user", "2025-01-01 00:02:00")], "kind string, at string").withColumn("at", F.to_timestamp("at"))
    assert streaming.events_per_window(batch).first()["n"] == 2
