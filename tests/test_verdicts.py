"""Edges of verdict passes, manual labels, outcomes, evaluation runs and the stored corpus."""

import json

import pytest

from promptquarry.operators import checks, evaluation, outcomes, search, verdicts
from promptquarry.sources import snapshots, store, transcripts

PAIR = "pair_id long, originating_prompt_id long, clarifying_prompt_id long, session_id long, clarification_kind string, clarification_text string, extraction_method string, extractor_version string, confidence double, reason string"
PROMPT = "prompt_id long, session_id long, project_id long, turn_index long, role string, content string, normalized_content string, eligible boolean"


@pytest.fixture
def pairs(spark):
    rows = [(i, i % 3, i + 10, 1, "constraint", f"never {i}", "rule", "v1", 0.5, None) for i in range(6)] + [(9, 0, 10, 1, "other", "old", "llm", "v1", 0.8, "r")]
    return spark.createDataFrame(rows, PAIR)


@pytest.fixture
def prompts(spark):
    return spark.createDataFrame([(i, 1, 1, i, "user", f"prompt number {i} about parsers", f"prompt number {i} about parsers", True) for i in range(20)], PROMPT)


def verdict_table(spark, ids):
    rows = [(i, i % 2 == 0 if i != 3 else None, "other", f"text {i}" if i != 4 else None, None, "why", None, None, None, 1, 1, 1, 7) for i in ids]
    return spark.createDataFrame(rows, "pair_id long, accepted boolean, kind string, text string, confidence double, reason string, error_class string, error_status int, error_message string, fresh_tokens long, cached_tokens long, out_tokens long, latency_ms long")


def test_verdict_pass(spark, pairs, prompts):
    recorded = verdicts.RecordedVerdicts(verdict_table(spark, range(6)))
    out = verdicts.verdict_pass(pairs, prompts, recorded, "v1")
    llm = sorted((r["clarification_text"], r["confidence"]) for r in out["pairs"].filter("extraction_method = 'llm'").collect())
    assert llm == [("text 0", 0.7), ("text 2", 0.7)]  # the old llm row goes, one without a text isn't stored
    assert [(r["pair_id"], r["error_message"]) for r in out["failed"].collect()] == [(3, "why")]
    assert {(r["outcome"], r["error"], r["n"], r["refined"]) for r in out["tally"].collect()} == {("accepted", None, 3, 3), ("rejected", None, 2, 0), ("failed", "Unknown", 1, 0)}
    again = verdicts.verdict_pass(pairs, prompts, recorded, "v1", retry=True)
    assert again["pairs"].filter("extraction_method = 'llm'").count() == 2 and again["failed"].count() == 0  # origins 1 and 2: pairs 1, 4, 2, 5
    nothing = verdicts.verdict_pass(pairs.filter("false"), prompts, recorded, "v1")
    assert nothing["pairs"].count() == nothing["tally"].count() == 0


def test_manual_rows(spark, pairs):
    rows = [(0, "accept", "x", "y", "z"), (1, "edit", "x", "y", "z"), (2, "fix-kind", "x", "y", "z"), (3, "reject", "x", "y", "z"), (4, "skip", "x", "y", "z"), (77, "accept", "x", "y", "z")]
    got = verdicts.manual_rows(pairs, spark.createDataFrame(rows, "pair_id long, action string, kind string, text string, reason string"), "v2").orderBy("from_pair_id").collect()
    assert [(r["clarification_kind"], r["clarification_text"], r["reason"]) for r in got] == [("constraint", "never 0", None), ("constraint", "y", None), ("x", "never 2", None), (None, "__rejected__", "z")]


def test_outcome_upsert(spark):
    old = spark.createDataFrame([(1, "unknown", 3), (2, "accepted", 4)], "session_id long, outcome string, turn_count long")
    new = spark.createDataFrame([(1, "rejected", 9), (3, "iterated", 5)], old.schema)
    assert {tuple(r) for r in outcomes.upserted_outcomes(old, new).collect()} == {(1, "rejected", 3), (2, "accepted", 4), (3, "iterated", 5)}


def test_common_lines_in_slices(spark, monkeypatch):
    files = spark.createDataFrame([(i, h) for i in range(40) for h in ("same", f"h{i // 4}", f"own{i}")], "snapshot_id long, content_hash string")
    left, right = files.filter("snapshot_id % 2 = 0").select("snapshot_id").distinct(), files.filter("snapshot_id % 2 = 1").select("snapshot_id").distinct()
    rows = lambda: sorted(map(tuple, outcomes.snapshot_overlap(files, left, right, 0.2).collect()))
    whole = rows()
    monkeypatch.setattr(outcomes, "SLICE", 6)
    monkeypatch.setattr(outcomes, "COMMON_SHARE", 10)
    assert rows() == whole and len(whole) == 400


def test_common_terms_in_slices(spark, prompts, monkeypatch):
    projects = spark.createDataFrame([(1, "p", None)], "project_id long, name string, cwd string")
    queries = spark.createDataFrame([(1, "parsers number 7", None), (2, "about", 1)], "query_id long, text string, project_id long")
    rows = lambda: sorted(map(tuple, search.retrieve(queries, prompts, projects, 30, porter=False).collect()))
    whole = rows()
    monkeypatch.setattr(search, "SLICE", 3)
    monkeypatch.setattr(search, "COMMON_SHARE", 5)
    assert rows() == whole and whole


def test_shape_cases_from_a_file(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"_notes": "x", "prompts": [{"shape": "vague", "text": "fix it"}, {"shape": "should-skip", "text": "b"}]}))
    rows = evaluation.shape_cases(spark, str(tmp_path / "p.json")).orderBy("case_id").collect()
    assert [(r["case_id"], r["shape"], r["prompt"], r["gold_pair_id"]) for r in rows] == [(0, "vague", "fix it", None), (1, "should-skip", "b", None)]
    assert evaluation.shape_cases(spark).count() == 20


def test_a_run_without_corpus_or_answers(spark, pairs, prompts):
    projects = spark.createDataFrame([(1, "p", None)], "project_id long, name string, cwd string")
    cases = evaluation.shape_cases(spark)
    found = evaluation.retrieved_for(cases, prompts.filter("false"), projects)
    none = spark.createDataFrame([], "prompt_id long, questions array<struct<text:string,kind:string,confidence:double>>, error_class string, fresh_tokens long, cached_tokens long, out_tokens long, latency_ms long")
    rows = evaluation.run_cases(cases, found, pairs, checks.RecordedAnswers(none), 5)
    got = rows.collect()
    assert len(got) == 20 and all(r["overlap_at_1"] is None and r["retrieved_ids"] == [] and r["correct_skip"] is None and r["synthetic_prompt"] for r in got)
    assert evaluation.run_row(rows, "shape-coverage").first()["overlap_at_3"] == 0.0


def test_stored_corpus(spark, tmp_path, prompts, pairs):
    store.save_corpus({"prompts": prompts, "pairs": pairs}, str(tmp_path))
    got = store.open_corpus(spark, str(tmp_path))
    assert set(got) == {"prompts", "pairs"} and got["prompts"].count() == 20
    with pytest.raises(ValueError):
        store.save_corpus({"other": prompts}, str(tmp_path))
    assert store.open_corpus(spark, str(tmp_path / "no")) == {}


def test_ingest_without_roots(spark):
    assert all(df.count() == 0 for df in transcripts.ingest(spark).values())


def test_trash_and_session_snapshots(spark, tmp_path):
    for name in ("My App/a.py", "My App/b/c.py", "loose.py", "s/local_1/outputs/x.py", "s/local_1/notes/y.py"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    files = snapshots.walk_files(spark, str(tmp_path))
    snaps, own = snapshots.trash_snapshots(files, "/trash")
    assert {(r["project_id"], r["source_path"], r["file_count"]) for r in snaps.collect()} == {("trash:my-app", "/trash/My App", 2), ("trash:s", "/trash/s", 2)}
    new, rest = snapshots.ingest_snapshots(snaps.filter("project_id = 'trash:s'"), snaps, own)
    assert [r["project_id"] for r in new.collect()] == ["trash:my-app"] and rest.count() == 2
    sessions = spark.createDataFrame([("w", "p", "cowork", f"file:{tmp_path}/s/local_1", "2025", True)], "session_id string, project_id string, source string, source_path string, ended_at string, eligible boolean")
    snaps, own = snapshots.session_snapshots(sessions, files)
    assert [(r["session_id"], r["file_count"]) for r in snaps.collect()] == [("w", 1)] and own.first()["relative_path"] == "x.py"
