"""Transcripts whose files are split far below their size, and files that are parsed once."""

import glob
import itertools
import json

import pytest
from pyspark.sql import functions as F

from promptquarry.sources import transcripts

SMALL = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "64"}


@pytest.fixture
def root(tmp_path):
    folder = tmp_path / "p"
    folder.mkdir()
    for name, n in (("long", 400), ("short", 3), ("windows", 40)):
        rows = []
        for i in range(n):
            role = "assistant" if i % 3 == 1 else "user"
            content = [{"type": "text", "text": f"é {i}"}, {"type": "tool_use", "name": "Read", "input": {"file_path": f"{i}.py"}}] if role == "assistant" else f"say {i} " + "x" * (i % 90)
            row = {"type": role, "message": {"role": role, "content": content}, "timestamp": f"2025-01-01T{i // 60:02}:{i % 60:02}:00Z", "sessionId": f"{name}-{i // 200}", "version": str(i), "cwd": f"/a/{i % 5}"}
            rows.append(json.dumps(row, ensure_ascii=False) if i % 11 else "{broken")
            if i % 50 == 7:
                rows.append(json.dumps({"type": "queue-operation", "operation": "enqueue", "content": "q"}))
        (folder / f"{name}.jsonl").write_bytes(("\r\n" if name == "windows" else "\n").join(rows).encode())
    return str(tmp_path)


def tables(spark, root):
    out = transcripts.ingest(spark, root)
    return {name: sorted((r.asDict(True) for r in df.collect()), key=str) for name, df in out.items()}


def test_small_splits_give_the_same_tables(spark, root):
    whole = tables(spark, root)
    before = {k: spark.conf.get(k, None) for k in SMALL}
    try:
        for k, v in SMALL.items():
            spark.conf.set(k, v)
        lines = transcripts.read_lines(spark, root)
        blocks = lines.groupBy(F.regexp_extract("path", "([^/]+)$", 1).alias("file")).agg(F.countDistinct("block").alias("n")).collect()
        split = tables(spark, root)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert {r["file"]: r["n"] for r in blocks}["long.jsonl"] > 50
    assert split == whole
    turns = sorted((p["turn_index"], p["content"]) for p in whole["prompts"] if "long" in p["session_id"])
    assert [t for t, _ in turns] == list(range(363)) and turns[0][1] == "é 1" and turns[1][1].startswith("say 2")


def test_files_are_read_once(spark, root):
    """No table's plan reads JSON lines: all start from the parsed events."""
    for df in transcripts.ingest(spark, root).values():
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "text" not in [line.split("Relation")[-1] for line in plan.splitlines() if "Relation" in line] and "parse_json" not in plan


def test_many_transcripts_lie_in_few_files(spark, sf_dir, tmp_path):
    """The files that the queries write follow the size, not the number of conversations; bundles give what single files give."""
    from promptquarry.plans import recorded
    from promptquarry.plans.queries import Corpus

    lines = recorded.transcript_rows(Corpus(spark, sf_dir).raw_turns)
    for file, own in itertools.groupby(sorted((r["file"], r["line_no"], r["line"]) for r in lines.collect()), lambda r: r[0]):
        (tmp_path / "single" / str(file)).mkdir(parents=True)
        (tmp_path / "single" / str(file) / "session.jsonl").write_text("\n".join(r[2] for r in own))
    path = F.concat(F.lit(f"file://{tmp_path}/single/"), F.col("file").cast("string"), F.lit("/session.jsonl"))
    transcripts.write_bundles(lines.select(path.alias("path"), "line_no", "line"), f"{tmp_path}/bundles")
    assert len(glob.glob(f"{tmp_path}/bundles/*.txt")) <= 4
    rows = lambda out: {k: sorted((str(sorted((x, str(y)) for x, y in r.asDict(True).items())).replace("file:///", "file:/") for r in df.collect())) for k, df in out.items()}
    assert rows(transcripts.ingest(spark, f"{tmp_path}/bundles", pattern="*.txt", bundled=True)) == rows(transcripts.ingest(spark, f"{tmp_path}/single"))
