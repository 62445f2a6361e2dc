"""op11 against all pairs, with exact integers; pieces, cells and stripes small enough that all phases run."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from promptquarry.llm import hard_negatives as hn

SCHEMA = "vec_id long, label int, vector array<double>"


def plain(rows, every=100):
    own = []
    for i, label, v in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            own.append((i, label, [math.floor(256 * x) for x in v]))
    out = []
    for i, label, v in own:
        if i % every:
            continue
        scores = [(-max(-(1 << 63) + 1, min((1 << 63) - 1, sum(a * b for a, b in zip(v, w)))), j, other) for j, other, w in own if j != i]
        scores.sort(key=lambda s: s[:2])
        for p, j, _ in [s for s in scores if s[2] == label][:5]:
            fits = [s for s in scores if s[2] != label and 80 * -p <= 100 * -s[0] <= 100 * -p][:5]
            out += [(i, j, k + 1, n, -p, -s) for k, (s, n, _) in enumerate(fits)]
    return sorted(out)


@pytest.fixture
def small(monkeypatch):
    for name, value in {"PIECE": 40, "ANCHORS": 12, "LEAF": 8, "ANCHOR_LEAF": 3, "STRIPE": 2, "CELLS": 8}.items():
        monkeypatch.setattr(hn, name, value)


def found(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA).repartition(4).withColumns({c: F.lit(1) for c in ("cell", "q", "salt", "scores", "n")})
    return sorted(map(tuple, hn.hard_negatives(df, **more).collect()))


def vectors(seed, n, dim, clusters, spread):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(clusters, dim))
    x = centres[r.integers(0, clusters, n)] + spread * r.normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True), r


def test_clusters_copies_and_ties(spark, small):
    x, r = vectors(1, 500, 6, 9, 0.2)
    x[100:260] = x[100]  # a third of all rows are copies
    x[300:340] = np.round(x[300:340] * 4) / 4  # ties
    rows = [(5 * i, int(r.integers(0, 4)), x[i].tolist()) for i in range(len(x))]
    assert found(spark, rows) == plain(rows) and plain(rows)
    assert found(spark, [(i, 1, v) for i, _, v in rows[:90]]) == []  # one label


def test_odd_rows(spark, small):
    x, r = vectors(2, 120, 4, 3, 0.4)
    rows = [(10 * i, int(r.integers(-2, 2)), v.tolist()) for i, v in enumerate(x)]
    rows += [(None, 1, [1.0] * 4), (1, None, [1.0] * 4), (2, 1, None), (200, 1, [1.0, None, 0.0, 0.0]), (300, 0, [float("nan")] * 4), (400, 0, [float("inf"), 0.0, 0.0, 0.0]), (-100, 0, [0.5, 0.5]), (7, 1, [0.6, 0.5]), (9, 0, [0.5, 0.6])]
    rows += [(500, 0, [1e12, -1e12, 3.0, 0.1]), (501, 1, [1e12, -1e12, 2.0, 0.1]), (502, 0, [1e12, -1e12, 3.5, 0.1])]
    assert found(spark, rows) == plain(rows)
    assert found(spark, []) == [] and found(spark, [(1, 1, None)]) == []


def test_repeated_rows_and_zero_scores(spark, small):
    rows = [(i % 40 * 50, i % 3, [float(i % 2), float(i % 5 == 0), 0.0]) for i in range(120)]
    got, expected = found(spark, rows), plain(rows)
    assert [r[:1] + r[2:3] + r[4:] for r in got] == [r[:1] + r[2:3] + r[4:] for r in expected]


def test_prunes_whole_groups():
    """Of clustered vectors most pairs of leaves are never scored."""
    x, r = vectors(3, 6000, 8, 12, 0.03)
    q, ids, labels = np.floor(256 * x), np.arange(6000), r.integers(0, 3, 6000)

    def tree(at, leaf):
        row = type("Row", (), {})()
        order, nodes = hn._grow(ids[at], labels[at], q[at], leaf)
        row.wide, row.ids, row.labels, row.q, row.tree = False, *hn._blobs(ids[at][order], labels[at][order], q[at][order].astype(np.int16), nodes)
        return hn.Tree(row, 8)

    anchors, others = tree(np.arange(0, 6000, 20), 4), tree(np.arange(6000), 16)
    best = hn.Best(anchors, 1, 5, True, np.full(300, hn.LOWEST + 1), np.full(300, hn.LONG))
    scored = []
    best.score = lambda a, o, b: (scored.append(1), hn.Best.score(best, a, o, b))
    best.search(others)
    leaves = (anchors.nodes[:, 2] < 0).sum() * (others.nodes[:, 2] < 0).sum()
    assert len(scored) < leaves / 8
    for k in random.Random(1).sample(range(300), 20):
        i, label = anchors.ids[k], anchors.labels[k]
        scores = (q @ q[i]).astype(np.int64)
        order = [j for j in np.lexsort((ids, -scores)) if j != i and labels[j] == label][:5]
        assert best.ids[k].tolist() == order
