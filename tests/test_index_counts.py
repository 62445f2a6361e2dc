"""Words of the ranked search's index are counted where their prompts are, without a shuffle of all of them."""

import random
from collections import Counter

import pytest

from promptquarry.operators import cells, search

FOUND = []
SCHEMA = "prompt_id long, project_id long, role string, eligible boolean, normalized_content string"


def prompts(ids, seed):
    r = random.Random(seed)
    texts = ["", "a", "a a a", "b a b", "Zoë zoe ZOE", " ,; ", None]
    rows = [(i, 0 if i is None else i % 3, "user", True, r.choice(texts) if r.random() < 0.3 else " ".join(f"w{int(9 * r.random() ** 2)}" for _ in range(r.randint(1, 40)))) for i in ids]
    return rows + [(1, 1, "assistant", True, "w1 other"), (2, 2, "user", False, "w1 other")]


def counted(rows):
    """By prompt, project and length together, as GROUP BY has them."""
    out = Counter()
    for i, project, role, eligible, text in rows:
        if role == "user" and eligible and text is not None:
            words = [w for w in text.lower().replace("ë", "e").replace(",", " ").replace(";", " ").split(" ") if w]
            out.update((i, project, len(words), w) for w in words)
    return out


def found(postings):
    return {(r["prompt_id"], r["project_id"], r["length"], r["term"]): r["tf"] for r in postings.collect()}


def test_no_shuffle_counts_words(spark):
    rows = prompts(range(200), 1)
    postings, stats = search.build_index(spark.createDataFrame(rows, SCHEMA).repartition(3), porter=False)
    assert found(postings) == counted(rows)
    assert "Aggregate" not in postings._jdf.queryExecution().executedPlan().toString()
    assert stats.first()["n_docs"] == 200


def test_rows_of_one_id_are_counted_together(spark):
    rows = prompts([*range(100), *[i % 5 for i in range(60)], None, None, None], 2)
    # the same id and length twice, and the same id in two lengths
    rows += [(300, 0, "user", True, "x y x"), (300, 0, "user", True, "x z z"), (301, 0, "user", True, "x"), (301, 0, "user", True, "x x")]
    postings, stats = search.build_index(spark.createDataFrame(rows, SCHEMA).repartition(3), porter=False)
    got = postings.collect()
    assert found(postings) == counted(rows) and len(got) == len(counted(rows))
    assert stats.first()["n_docs"] == 167


def test_nothing_asked(spark):
    asked = spark.createDataFrame([], "query_id long, group string, term string, times double, k int, m double, bound double")
    rows = cells.best(asked, spark.createDataFrame([("g", "t", 1, 1.0, 0.0)], "group string, term string, doc_id long, impact double, base double"))
    assert rows.count() == 0 and rows.dtypes == [("group", "string"), ("query_id", "bigint"), ("doc_id", "bigint"), ("total", "double")]


@pytest.mark.parametrize("most", [0, 200_000])
def test_few_terms_are_sent_to_postings(spark, monkeypatch, most):
    monkeypatch.setattr(cells, "BROADCAST_TERMS", most)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        texts = [(i, i % 3, "user", True, f"please change the login handler number{i % 4} in the server module") for i in range(50)]
        own = spark.createDataFrame(texts, SCHEMA).selectExpr("*", "normalized_content AS content")
        projects = spark.createDataFrame([(i, f"p{i}", "/home/x") for i in range(3)], "project_id long, name string, cwd string")
        queries = spark.createDataFrame([(1, "login number2", None), (2, "handler number3", 1)], "query_id long, text string, project_id long")
        kinds, made = [], search.kept
        monkeypatch.setattr(search, "kept", lambda df, label: (kinds.append((label, df._jdf.queryExecution().executedPlan().toString())), made(df, label))[1])
        got = sorted((r["query_id"], r["prompt_id"]) for r in search.retrieve(queries, own, projects, 4, porter=False).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    plan = dict(kinds)["postings"]
    assert ("SortMergeJoin" in plan) == (most == 0) and ("BroadcastHashJoin" in plan) == (most > 0)
    assert len(got) == len(set(got)) and {q for q, _ in got} == {1, 2}
    FOUND.append(got)
    assert all(x == got for x in FOUND)
