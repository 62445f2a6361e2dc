"""op12 against all pairs, and the number of rows that a large group makes."""

import random

from pyspark.sql import functions as F

from promptquarry.llm import ngram_join
from tests.llm import brute
from tests.llm.conftest import SCHEMA, prose


def shingles(text):
    w = brute.words(text)
    return frozenset([tuple(w[j : j + 3]) for j in range(len(w) - 2)] if len(w) >= 3 else ([tuple(w)] if w else []))


def plain(rows, percent=90):
    """(doc_id, n_shingles, component) per row; a doc_id with several texts is one node."""
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, (i, a) in enumerate(sets):
        for j, b in sets[x + 1 :]:
            if a and b and i is not None and j is not None and 100 * len(a & b) >= percent * len(a | b):
                u, v = sorted((find(i), find(j)))
                parent[v] = u
    return sorted(((i, len(s), find(i) if s and i is not None else i) for i, s in sets), key=str)


def found(df, **more):
    return sorted(map(tuple, ngram_join.join_components(df, **more).collect()), key=str)


def test_hard_rows(spark, hard, hard_rows, clashing, empty):
    expected = plain([r[:2] for r in hard_rows])
    assert found(hard) == expected == found(clashing)
    assert found(empty) == []
    again = hard_rows + [(None, "one two three four", None, None, None), (3, hard_rows[8][1], None, None, None), (8, "one", None, None, None)]
    assert found(spark.createDataFrame(again, SCHEMA)) == plain([r[:2] for r in again])


def test_pairs_around_the_threshold(spark):
    """Texts that differ in 1 to 8 words, appended to and cut, chains of changes, and shared boilerplate."""
    r, rows = random.Random(5), []
    for family in range(40):
        words = prose(family, r.randint(12, 160), 3000).split()
        for _ in range(r.randint(1, 6)):
            own = list(words)
            for _ in range(r.randint(0, 5)):
                own[r.randrange(len(own))] = f"y{r.randrange(50)}"
            own = own[: len(own) - r.randint(0, 6)] + ["tail"] * r.randint(0, 3)
            rows.append((len(rows), " ".join(own) + (" all rights are reserved by us" if r.random() < 0.5 else "")))
            if r.random() < 0.3:
                words = own
    for percent in (90, 60):
        assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), percent=percent) == plain(rows, percent)


def test_large_group_makes_few_links(spark, monkeypatch):
    """1,500 near copies: links grow with the rows, and the blocks don't change the result."""
    base = prose(1, 200, 5000).split()
    rows = []
    for i in range(1500):
        own = list(base)
        own[i % 200] = f"z{i}"
        rows.append((i, " ".join(own)))
    monkeypatch.setattr(ngram_join, "DEALT", 64)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r[2] for r in found(df)} == {0}
    members = df.mapInPandas(ngram_join._members(3), ngram_join.MEMBER_SCHEMA)
    classes = members.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min("n_shingles").alias("n_shingles"))
    sets = ngram_join.shared_sets(df, classes, 3, 90)
    assert sets.count() == 1500 and ngram_join.links(sets, 90).count() < 60_000
