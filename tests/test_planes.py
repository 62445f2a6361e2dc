"""Counts in bit planes against plain counts, and how few of the files that share a word are looked at."""

import random

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from promptquarry.functions import text as T
from promptquarry.operators import checks, planes


def plain(asked, files, k):
    out = {}
    for query, group, words in asked:
        own = [(-round(len(set(words) & set(w)) / len(words) * 0.5 + base, 9), doc, len(set(words) & set(w))) for g, doc, base, w in files if g == group and set(words) & set(w)]
        if own:
            out[query] = [(doc, n) for _, doc, n in sorted(own)[:k]]
    return out


def made(seed, n_files, n_queries, groups):
    r = random.Random(seed)
    word = lambda: f"word{int(400 * r.random() ** 3)}"
    # few bases, so that many scores are equal; texts as long as three, and as 300 words
    files = [(groups[i % len(groups)], i // len(groups), r.randint(0, 6) / 12, list({word() for _ in range(r.choice((3, 30, 300)))})) for i in range(n_files)]
    asked = [(q, groups[q % len(groups)], list({word() if r.random() < 0.9 else f"other{r.randint(0, 99)}" for _ in range(r.choice((1, 2, 8, 40)))})) for q in range(n_queries)]
    return asked + [(n_queries, groups[0], ["nowhere"]), (n_queries + 1, "no files", ["word1"])], files


@pytest.mark.parametrize("part, block, dense, step, k", [(4_000_000, 20_000, 512, 8192, 3), (20_000, 200, 16, 8, 2), (3_000, 60, 1, 1, 1), (100_000, 90, 100_000, 64, 5)])
def test_first_files(spark, monkeypatch, part, block, dense, step, k):
    for name, value in (("PART", part), ("LEAST_BLOCK", block), ("MOST_BLOCK", block), ("DENSE", dense), ("STEP", step), ("MERGED", 50)):
        monkeypatch.setattr(planes, name, value)
    asked, files = made(part, 700, 90, ["a", "b", "c"])
    sizes = spark.createDataFrame([(g, sum(len(" ".join(w)) for x, *_, w in files if x == g)) for g in "abc"], "group string, size long")
    found = planes.best(spark.createDataFrame(asked, "query_id long, group string, words array<string>"), spark.createDataFrame([(g, d, b, " ".join(w)) for g, d, b, w in files], "group string, doc_id long, base double, text string"), sizes, k, 0.5, 64)
    plan = found._jdf.queryExecution().executedPlan().toString()
    got, group, wanted, base, words = {}, {q: g for q, g, _ in asked}, {q: w for q, _, w in asked}, {(g, d): b for g, d, b, _ in files}, {(g, d): w for g, d, _, w in files}
    for x in found.collect():
        assert x["group"] == group[x["query_id"]] and x["base"] == base[x["group"], x["doc_id"]]
        assert x["shared"] == ",".join(w for w in wanted[x["query_id"]] if w in words[x["group"], x["doc_id"]])
        got.setdefault(x["query_id"], []).append((-round(x["n"] / x["m"] * 0.5 + x["base"], 9), x["doc_id"], x["n"]))
    assert {q: [(d, n) for _, d, n in sorted(own)[:k]] for q, own in got.items()} == plain(asked, files, k)
    # parts are read by the task of each block, not shuffled to them
    assert "CartesianProduct" in plan and "Cogroup" not in plan


def test_few_files_are_looked_at(monkeypatch):
    asked, files = made(9, 4_000, 400, ["a"])
    key, values = (pa.scalar("a"), pa.scalar(0)), lambda table, c: planes._unpacked(table.column(c)[0])
    part = values(planes._part(key, pa.table({"doc_id": [x[1] for x in files], "base": [x[2] for x in files], "text": [" ".join(x[3]) for x in files]})), "part")
    block = values(planes._block(key, pa.table({"query_id": [x[0] for x in asked if x[1] == "a"], "words": [x[2] for x in asked if x[1] == "a"]})), "block")
    looked, add = [], planes._Block.add
    monkeypatch.setattr(planes._Block, "add", lambda self, rows: (looked.append(len(rows[0])), add(self, rows)))
    own = planes._Block(block, 3, 0.5)
    own.meet(part, checks.FIRST)
    shared = sum(bool(set(a) & set(w)) for _, g, a in asked if g == "a" for *_, w in files)
    assert shared > 300_000 and sum(looked) < shared / 10
    # a second part without any better file leaves no file to be looked at
    looked.clear()
    own.meet(part | {"bases": pc.subtract(part["bases"], 9.0)}, checks.FIRST)
    assert not looked


def test_words_are_keywords(spark, monkeypatch):
    texts = ["", "abc", "abcd", "efgh with_under 12345 a-b-c ab.cdef", "naïveté straße ÇAbcd İSTANBUL \u212aelvin", "word word\nword\tword9", "with THIS from their", "x" * 50, "日本語abcd日本", "a" * 3 + "é" + "b" * 4, "😀abcd😀"]
    r = random.Random(8)
    texts += ["".join(r.choice("abAB19_ -.é\n😀İ") for _ in range(r.randint(0, 60))) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, content string").select("doc_id", F.lower("content").alias("text"), T.keywords(F.col("content")).alias("words")).collect()
    for most in (1, 40, 4_000_000):
        monkeypatch.setattr(planes, "TEXT", most)
        table = pa.table({"doc_id": [x["doc_id"] for x in rows], "base": [0.5] * len(rows), "text": [x["text"] for x in rows]})
        part = planes._unpacked(planes._part((pa.scalar(1), pa.scalar(0)), table).column("part")[0])
        got, docs, places = {}, part["docs"].to_pylist(), iter(part["places"].to_pylist())
        for word, n in zip(part["words"].to_pylist(), part["counts"].to_pylist()):
            for _ in range(n):
                got.setdefault(docs[next(places)], []).append(word)
        assert {d: sorted(w) for d, w in got.items()} == {x["doc_id"]: sorted(x["words"]) for x in rows if x["words"]}


def test_matched_words(spark):
    files = [(1, "SOUL.md", 1, "Gamma alpha with beta"), (1, "README.md", 2, None), (1, "README.md", 3, "")]
    prompts = [(1, 1, "beta delta ALPHA, beta"), (2, 1, None), (3, 1, "nothing"), (4, 2, "alpha")]
    found = checks.context_relevance(spark.createDataFrame(prompts, "prompt_id long, project_id long, content string"), spark.createDataFrame(files, "project_id long, name string, position long, content string"))
    got = {(x["prompt_id"], x["place"]): (x["name"], x["matched"]) for x in found.collect()}
    assert got == {(p, k): (name, "beta,alpha" if (p, k) == (1, 1) else "") for p in (1, 2, 3) for k, name in ((1, "SOUL.md"), (2, "README.md"), (3, "README.md"))}
