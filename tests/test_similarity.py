"""The similarity join of snapshots against all pairs, and how few pairs it looks at."""

import random

import pytest
from pyspark.sql import functions as F

from promptquarry.operators import outcomes


def plain(sets, left, right, least):
    out = []
    for a in left:
        for b in right:
            both = len(sets[a] & sets[b])
            if both and both / len(sets[a] | sets[b]) >= least:
                out.append((a, b, round(both / len(sets[a] | sets[b]), 9)))
    return sorted(out)


@pytest.fixture(scope="module")
def snapshots():
    """Families of similar sets, copies on both sides, boilerplate that most of them share, sets of boilerplate only."""
    r, sets = random.Random(2), {}
    boilerplate = [f"common{i}" for i in range(6)]
    for family in range(30):
        base = [f"{family}-{i}" for i in range(r.randint(1, 14))]
        for _ in range(r.randint(1, 5)):
            own = {x if r.random() > 0.2 else f"x{r.randrange(10**6)}" for x in base} | set(r.sample(boilerplate, r.randint(0, 4)))
            sets[len(sets)] = own
    for _ in range(12):
        sets[len(sets)] = set(sets[3])
    sets[len(sets)] = set(boilerplate)
    sets[len(sets)] = set(boilerplate[:5])
    left = [i for i in sets if i % 3]
    right = [i for i in sets if i % 3 != 1]  # some are on both sides
    return sets, left, right


def frames(spark, snapshots):
    sets, left, right = snapshots
    files = spark.createDataFrame([(i, h) for i, own in sets.items() for h in own for _ in range(1 + i % 2)], "snapshot_id long, content_hash string")
    one = lambda ids: spark.createDataFrame([(i,) for i in ids], "snapshot_id long")
    return files.withColumns({"n": F.lit(1), "k": F.lit(2)}), one(left), one(right)


@pytest.mark.parametrize("least", [0.5, 0.3, 0.8, 1.0])
def test_all_pairs_are_found(spark, snapshots, least):
    got = sorted((r["left_id"], r["right_id"], round(r["jaccard"], 9)) for r in outcomes.snapshot_overlap(*frames(spark, snapshots), least).collect())
    assert got == plain(*snapshots, least)


def test_first_overlap(spark, snapshots):
    first = {}
    for a, b, j in plain(*snapshots, 0.5):
        first.setdefault(a, (b, j))
    got = {r["left_id"]: (r["right_id"], round(r["jaccard"], 9)) for r in outcomes.first_overlap(*frames(spark, snapshots)).collect()}
    assert got == first


def test_few_candidates(spark):
    """400 sets with six lines in common and twelve of their own or a neighbour's: pairs with a common line are all pairs."""
    sets = {i: {f"common{c}" for c in range(6)} | {f"{i // 4}-{k}" for k in range(12)} for i in range(400)}
    for i in range(400):
        sets[i].add(f"own{i}")
    files, left, right = frames(spark, (sets, [i for i in sets if i % 2], [i for i in sets if not i % 2]))
    own = files.select("snapshot_id", "content_hash").distinct()
    side = lambda ids, name: own.join(ids, "snapshot_id").withColumnRenamed("snapshot_id", name)
    before = side(left, "l").join(side(right, "r"), "content_hash").select("l", "r").distinct().count()
    found = outcomes.similar_snapshots(files, left, right)
    assert before == 200 * 200 and found.candidates.count() == found.pairs.count() == 400


def test_no_snapshots(spark, snapshots):
    files, left, right = frames(spark, snapshots)
    assert outcomes.snapshot_overlap(files, left.limit(0), right).count() == 0
    assert outcomes.first_overlap(files.limit(0), left, right).count() == 0
