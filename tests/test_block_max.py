"""Ranked search by blocks of greatest impact against the ranks of all prompts, and how few postings it reads."""

import random

import pytest
from pyspark.sql import functions as F

from promptquarry.operators import search


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(11)
    word = lambda: f"w{int(400 * r.random() ** 3)}"
    prompts = [(i, f"p{i % 7 % 4}", "user", True, " ".join(word() for _ in range(r.randint(3, 60)))) for i in range(1500)]
    prompts += [(2000 + i, "p1", "user", True, "w1 w2 same text w77") for i in range(40)]  # ties
    queries = [(i, " ".join(word() for _ in range(r.randint(1, 9))), None if i % 3 else f"p{i % 5}") for i in range(40)]
    queries += [(100, "w1 w1 w2 w77", None), (101, "unknown", None), (102, "w0", "p1"), (103, "", None)]
    prompts = spark.createDataFrame(prompts, "prompt_id long, project_id string, role string, eligible boolean, normalized_content string").repartition(4)
    queries = spark.createDataFrame(queries, "query_id long, text string, scope string")
    postings, stats = search.build_index(prompts, porter=False)
    # whole words as terms, so that a term may be asked twice
    terms = queries.select("query_id", F.explode(F.filter(F.split("text", " "), lambda w: w != "")).alias("term"))
    return postings.cache(), stats, terms, queries.select("query_id", "scope")


def first(rows, k):
    out = {}
    for r in rows.collect():
        out.setdefault(r["query_id"], []).append((round(r["rank"], 9), r["prompt_id"], r["project_id"]))
    return {q: sorted(own)[:k] for q, own in out.items()}


@pytest.mark.parametrize("k,part", [(5, 8192), (1, 8192), (30, 4), (5000, 8192)])
def test_first_of_every_query(spark, corpus, monkeypatch, k, part):
    postings, stats, terms, scopes = corpus
    monkeypatch.setattr(search, "SLICE", part)
    monkeypatch.setattr(search, "COMMON_SHARE", 20 if part == 4 else search.COMMON_SHARE)
    projects = spark.createDataFrame([("p0",), ("p1",), ("p2",)], "project_id string")
    index = search.impact_blocks(terms, postings, stats, projects)
    got = first(search.best_ranked(terms.join(scopes, "query_id").withColumn("k", F.lit(k)), index), k)
    every = search.rank(terms, postings, stats).join(projects, "project_id", "left_semi").join(scopes, "query_id").filter("scope IS NULL OR scope = project_id")
    assert got == first(every, k) and len(got) > 30


def test_few_postings_are_read(spark, corpus):
    postings, stats, terms, scopes = corpus
    index = search.impact_blocks(terms, postings, stats, postings.select("project_id").distinct())
    asked = terms.join(scopes, "query_id").withColumn("k", F.lit(5))
    read, _ = search.scored_blocks(asked.withColumn("scope", F.lit(None).cast("string")), index)
    n_read = read.join(index.postings, search.BLOCK).count()
    n_all = terms.distinct().join(postings, "term").count()
    assert n_read < n_all / 2
