"""A stored corpus in versions: writes that die, readers that stay, and ingests that are repeated."""

import json

import pytest
from pyspark.sql import functions as F

from promptquarry.sources import corpus, store, transcripts


def rows(df):
    return sorted((r.asDict(True) for r in df.collect()), key=str)


def write(root, name, texts, project="p", day=1):
    (root / project).mkdir(parents=True, exist_ok=True)
    body = [{"type": "user" if i % 2 == 0 else "assistant", "message": {"role": "user" if i % 2 == 0 else "assistant", "content": t if i % 2 == 0 else [{"type": "text", "text": t}, {"type": "tool_use", "name": "Read", "input": {"path": t}}]}, "timestamp": f"2025-01-{day:02}T00:00:{i:02}Z", "sessionId": name, "cwd": f"/home/me/{project}", "version": str(day)} for i, t in enumerate(texts)]
    (root / project / f"{name}.jsonl").write_text("\n".join(map(json.dumps, body)))


def test_repeated_ingest(spark, tmp_path):
    files, root = tmp_path / "files", str(tmp_path / "corpus")
    for i in range(12):
        write(files, f"s{i}", [f"a{i}", f"b{i}", f"c{i}"], project=f"p{i % 3}")
    corpus.merged_into(spark, root, transcripts.ingest(spark, str(files)))
    first = store.open_corpus(spark, root)
    pinned = rows(first["prompts"])
    one = store.read_version(spark, root)
    again = tmp_path / "again"
    write(again, "s3", ["new a", "new b"], project="p0", day=2)
    write(again, "s99", ["x"], project="p9", day=3)
    corpus.merged_into(spark, root, transcripts.ingest(spark, str(again)))
    two, now = store.read_version(spark, root), store.open_corpus(spark, root)
    assert two.number == 2 and rows(first["prompts"]) == pinned and rows(store.open_corpus(spark, root, 1)["prompts"]) == pinned
    contents = {(p["session_id"], p["turn_index"]): p["content"] for p in rows(now["prompts"])}
    assert contents == {(f"s{i}", t): f"{c}{i}" for i in range(12) if i != 3 for t, c in enumerate("abc")} | {("s3", 0): "new a", ("s3", 1): "new b", ("s99", 0): "x"}
    ids = [p["prompt_id"] for p in rows(now["prompts"])]
    assert len(set(ids)) == len(ids) and min(p["prompt_id"] for p in rows(now["prompts"]) if p["session_id"] in ("s3", "s99")) > max(p["prompt_id"] for p in pinned)
    calls = rows(now["tool_calls"])
    assert {c["file_path"] for c in calls if c["session_id"] == "s3"} == {"new b"} and {c["prompt_id"] for c in calls} <= set(ids) and all(c["tool_call_id"]["prompt_id"] == c["prompt_id"] for c in calls)
    s3 = next(s for s in rows(now["sessions"]) if s["session_id"] == "s3")
    assert s3["started_at"].startswith("2025-01-01") and s3["ended_at"].startswith("2025-01-02") and s3["turn_count"] == 2
    assert len(rows(now["projects"])) == 4 and next(p for p in rows(now["projects"]) if p["cwd"] == "/home/me/p0")["last_seen_at"].startswith("2025-01-02")
    # only parts with a session that came again are new
    changed = [p for p, f in two.tables["prompts"]["parts"].items() if one.tables["prompts"]["parts"].get(p) != f]
    assert 1 <= len(changed) <= 2 < len(one.tables["prompts"]["parts"])
    assert store.drop_versions(spark, root) > 0 and rows(store.open_corpus(spark, root)["prompts"]) == rows(now["prompts"])


def test_a_write_that_dies(spark, tmp_path):
    """An error midway leaves the version before; the next write succeeds."""
    files, root = tmp_path / "files", str(tmp_path / "corpus")
    write(files, "s1", ["a", "b"])
    new = transcripts.ingest(spark, str(files))
    corpus.merged_into(spark, root, new)
    before = {t: rows(df) for t, df in store.open_corpus(spark, root).items()}
    broken = dict(new, tool_calls=new["tool_calls"].withColumn("file_path", F.raise_error(F.lit("killed")).cast("string")))
    with pytest.raises(Exception, match="killed"):
        corpus.merged_into(spark, root, broken)
    assert store.version_numbers(spark, root) == [1]
    assert {t: rows(df) for t, df in store.open_corpus(spark, root).items()} == before
    corpus.merged_into(spark, root, new)
    assert store.version_numbers(spark, root) == [1, 2]


def test_two_writers(spark, tmp_path):
    root = str(tmp_path)
    base = store.read_version(spark, root)
    df = spark.createDataFrame([(1, "a")], "session_id long, role string")
    store.save_corpus({"prompts": df}, root)
    with pytest.raises(store.ConcurrentWrite):
        store.commit(spark, root, base, {"pairs": store.write_parts(df, "pairs", root)})
    assert set(store.open_corpus(spark, root)) == {"prompts"}


def test_an_empty_table_keeps_its_columns(spark, tmp_path):
    df = spark.createDataFrame([], "session_id long, role string")
    store.save_corpus({"prompts": df}, str(tmp_path))
    got = store.open_corpus(spark, str(tmp_path))["prompts"]
    assert got.columns == df.columns and got.count() == 0
