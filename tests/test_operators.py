import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from promptquarry.operators import checks, scoring, search

DOCS = [
    "fix the auth tests in login now", "test login testing tests", "the dashboard needs colours", "auth auth auth handler refactor deploy",
    "résumé parser running runs ran", "nothing relevant here whatsoever at all",
]


def ranks(spark, query):
    prompts = spark.createDataFrame([(i, 0, "user", True, t) for i, t in enumerate(DOCS)], "prompt_id long, project_id long, role string, eligible boolean, normalized_content string")
    postings, stats = search.build_index(prompts)
    terms = search.query_terms(spark.createDataFrame([(1, query)], "query_id long, text string"))
    return {r["prompt_id"]: r["rank"] for r in search.rank(terms, postings, stats).collect()}


@pytest.mark.parametrize("query", ["test auth", "test tests", "run", "resume"])
def test_bm25_matches_sqlite(spark, query):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(content, tokenize = 'porter unicode61')")
    con.executemany("INSERT INTO f(rowid, content) VALUES (?, ?)", enumerate(DOCS))
    want = dict(con.execute("SELECT rowid, bm25(f) FROM f WHERE f MATCH ?", (" OR ".join(f'"{w}"' for w in query.split()),)))
    got = ranks(spark, query)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def run(spark, text, enabled=checks.V.ENABLED_CHECKS, tokens=0, limit=4000):
    prompts = spark.createDataFrame([(1, text, tokens, 0)], "prompt_id long, content string, context_tokens long, context_files long")
    return checks.run_checks(prompts, enabled, limit).collect()


def test_checks(spark):
    assert any("files" in r["message"] for r in run(spark, "refactor auth") if r["type"] == "warning")
    assert any("test" in r["message"] for r in run(spark, "add login"))
    assert any("local environment" in r["message"] for r in run(spark, "fix bug in /Users/example/code"))
    done = run(spark, "Update src/auth/login.js so that tests pass; you should not change the API")
    assert sum(r["type"] == "warning" for r in done) < 3


def test_pipeline():
    assert [c.id for c in checks.build_pipeline(["local-env", "files-mentioned", "unknown"])] == ["files-mentioned", "local-env"]
    assert checks.build_pipeline([]) == [] and len(checks.REGISTRY) == 7


def test_no_checks_no_results(spark):
    assert run(spark, "refactor auth", []) == []
    assert len(run(spark, "refactor auth", ["files-mentioned"])) == 1
    assert run(spark, "refactor auth", ["corpus-clarify"]) == []


@pytest.mark.parametrize(("total", "want"), [(800, []), (801, ["warning"]), (1000, ["warning"]), (1001, ["error"])])
def test_context_window(spark, total, want):
    assert [r["type"] for r in run(spark, "", ["context-window"], total, 1000)] == want


def test_scores(spark):
    q = "array<struct<text:string,kind:string,confidence:double>>"
    rows = [
        (1, "constraint", "alpha beta", [("gamma", "constraint", 0.5)]),
        (2, None, "__rejected__", []),
        (3, "constraint", "alpha beta gamma", [("alpha beta", "other", 0.1), ("zeta", "other", 0.9)]),
    ]
    scores = {r["case_id"]: r for r in scoring.score_cases(spark.createDataFrame(rows, f"case_id long, gold_kind string, gold_text string, questions {q}")).collect()}
    assert scores[1]["overlap_at_1"] == 0.5 and scores[1]["kind_match_any"]
    assert scores[2]["overlap_at_3"] == 0.0 and scores[2]["proposed"] == 0
    assert scores[3]["overlap_at_1"] == 0.0 and abs(scores[3]["overlap_at_3"] - 2 / 3) < 1e-12


def test_budget_overshoots_by_one(spark):
    cases = spark.createDataFrame([(i, 1, 1.0) for i in range(4)], "case_id long, run_id long, cost_usd double")
    assert scoring.within_budget(cases, 2.0).count() == 3


def test_budget_in_ranges(spark, monkeypatch):
    """Sums of ranges and inside of them against a plain sum, with a run without id, costs that are missing and gaps."""
    r = random.Random(9)
    rows = [(i * r.choice([1, 1, 3]) + 1000 * i, run, None if i % 13 == 0 else round(r.random(), 3)) for run, n in ((1, 120), (2, 45), (None, 30), (4, 1)) for i in range(n)]
    expected = set()
    for run in (1, 2, None, 4):
        spent = 0.0
        for i, _, cost in sorted(x for x in rows if x[1] == run):
            if round(spent, 9) <= 11.0:
                expected.add((i, run, round(spent, 6)))
            spent += cost or 0.0
    cases = spark.createDataFrame(rows, "case_id long, run_id long, cost_usd double").repartition(3)
    for size in (100_000, 7):
        monkeypatch.setattr(scoring, "RANGE", size)
        assert {(x["case_id"], x["run_id"], round(x["spent_before"], 6)) for x in scoring.within_budget(cases, 11.0).collect()} == expected


def test_corpus_clarify_shapes(spark):
    prompts = spark.createDataFrame([(i,) for i in range(4)], "prompt_id long")
    found = spark.createDataFrame([(1, 3), (2, 3), (3, 3)], "prompt_id long, n long")
    answers = spark.createDataFrame(
        [(1, None, "RateLimit", 429, "slow down", None), (2, [], None, None, None, "clear"), (3, [("q?",)], None, None, None, None)],
        "prompt_id long, questions array<struct<text:string>>, error_class string, error_status int, error_message string, skip_reason string",
    )
    got = {r["prompt_id"]: r for r in checks.corpus_clarify(prompts, found, checks.RecordedAnswers(answers)).collect()}
    assert got[0]["message"].startswith("No relevant") and got[1]["message"] == "Corpus-clarify failed: RateLimit(429)"
    assert got[2]["suggestion"] == "clear" and got[3]["message"] == "1 clarifying question grounded in your corpus"


def test_empty_inputs(spark):
    empty = spark.createDataFrame([], "prompt_id long, content string, context_tokens long, context_files long")
    assert checks.run_checks(empty).count() == 0
    scores = spark.createDataFrame([], "case_id long, gold_kind string, overlap_at_1 double, overlap_at_3 double, kind_match_top1 boolean, kind_match_any boolean")
    assert tuple(scoring.aggregate(scores).first()) == (0, 0.0, 0.0, 0.0, 0.0)
    assert scores.agg(F.sum("overlap_at_1")).first()[0] is None
