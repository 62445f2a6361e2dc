import hashlib
import random

import numpy as np
import pytest

from promptquarry.llm import exact_dedup, frontcoded, near_dedup, shingles, substring_dedup
from promptquarry.llm.components import connected_components
from tests.llm import brute
from tests.llm.conftest import SCHEMA, prose


def test_merge_of_runs():
    r = random.Random(7)
    runs = [sorted(bytes(r.choices(b"ab", k=r.randrange(0, 12))) for _ in range(r.randrange(0, 40))) for _ in range(5)]
    coded = [frontcoded.decode(frontcoded.encode(x)) for x in runs]
    assert [c[0] for c in coded] == runs
    last, out = b"", []
    for run, i, known in frontcoded.merge(coded):
        assert known == frontcoded.lcp(last, runs[run][i]) or not out
        last = runs[run][i]
        out.append(last)
    assert out == sorted(x for run in runs for x in run)
    assert list(frontcoded.merge([])) == []


def test_sliding_least():
    x = np.random.default_rng(1).integers(0, 1000, 1000, dtype=np.uint64)
    assert (substring_dedup.sliding_least(x, 37) == np.array([x[i : i + 37].min() for i in range(964)])).all()


def test_substring_dedup(hard, hard_rows):
    rows = [(r[0], r[1]) for r in hard_rows]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in substring_dedup.remove_repeats(hard).collect()}
    assert got == dict(zip([i for i, _ in rows], brute.repeats(rows)))


def test_substring_dedup_gives_texts_and_ranges(hard, hard_rows):
    texts = {r[0]: (r[1] or "").encode() for r in hard_rows}
    got = {r["doc_id"]: r for r in substring_dedup.remove_repeats(hard).collect()}
    assert set(got) == set(texts) and any(r["removed"] for r in got.values())
    for i, row in got.items():
        at, left = 0, b""
        for a, b in row["removed"]:
            left, at = left + texts[i][at:a], b
        assert bytes(row["kept"]) == left + texts[i][at:]
        assert hashlib.sha256(row["kept"]).hexdigest() == row["kept_sha256"] and len(row["removed"]) == row["n_spans"]


def test_substring_dedup_short_strings(spark):
    r = random.Random(3)
    parts = ["".join(r.choices("abcd", k=k)) for k in (30, 41, 55, 70)]
    rows = [(i, "".join(r.choice(parts) if r.random() < 0.4 else "".join(r.choices("abcd", k=r.randrange(1, 40))) for _ in range(8))) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    own = substring_dedup._identified(df)
    spans = {}
    for s in substring_dedup.repeated_spans(own, 40, 16).collect():
        spans.setdefault(s["id"], []).append((s["a"], s["b"]))
    got = [(len(t), sum(b - a for a, b in substring_dedup.union_of(spans.get(i, []), 40)), len(substring_dedup.union_of(spans.get(i, []), 40))) for i, t in rows]
    assert got == [x[:3] for x in brute.repeats(rows, 40)]


def test_substring_dedup_edges(spark, empty, clashing):
    assert substring_dedup.remove_repeats(empty).count() == 0
    assert substring_dedup.remove_repeats(clashing).count() == clashing.count()
    twice = spark.createDataFrame([(1, "q" + prose(9, 100)), (1, "q" + prose(9, 100)), (None, prose(10, 100))], "doc_id long, text string")
    assert sorted((r["doc_id"] is None, r["n_bytes"] - r["n_removed"] == 0) for r in substring_dedup.remove_repeats(twice).collect()) == [(False, True), (False, True), (True, False)]


def test_shingles_match_words():
    texts = [b"", b" \n", b"a b c", b"A b C", b"a b c d e f", b"a  b\tc\nd e", b"x" * 300]
    sets = list(shingles.shingle_sets(texts))
    assert [len(s) for s in sets] == [0, 0, 1, 1, 2, 1, 1]
    assert len(next(shingles.shingle_sets([b"a b"]))) == 1
    assert (sets[2] == sets[3]).all() and sets[5][0] in sets[4]


def test_near_dedup(hard, hard_rows):
    want = brute.near([(r[0], r[1]) for r in hard_rows])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.groups(hard).collect()}
    assert got == want


@pytest.mark.parametrize("percent", [80, 85])
def test_near_dedup_of_a_family(spark, percent):
    """Variants of one text with one to six changed words: hubs alone don't settle these."""
    r, base, rows = random.Random(5), prose(11, 150, 5000).split(), []
    for i in range(150):
        own = list(base)
        for k in r.sample(range(150), r.randrange(0, 7)):
            own[k] = "v%d" % r.randrange(10**6)
        rows.append((1000 - i, " ".join(own)))
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in near_dedup.groups(spark.createDataFrame(rows, "doc_id long, text string"), percent).collect()}
    assert got == brute.near(rows, percent)


def test_near_dedup_edges(spark, empty, clashing):
    assert near_dedup.groups(empty).count() == 0 and near_dedup.keep_one_of_each(empty).count() == 0
    kept = near_dedup.keep_one_of_each(clashing)
    assert kept.columns == clashing.columns and 0 < kept.count() < clashing.count()
    a, b = prose(21, 50), prose(22, 50)
    rows = spark.createDataFrame([(5, a), (5, b), (3, b), (7, a), (None, a)], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["component_id"], r["kept"]) for r in near_dedup.groups(rows).collect())
    assert got == [(-1, None, True), (3, 3, True), (5, 3, False), (5, 3, False), (7, 3, False)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(60) if i % 20 != 19] + [(100, 101), (5, 5)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: i // 20 * 20 for i in range(60)}, 60: 40, 100: 100, 101: 100} or got == {**{i: i // 20 * 20 for i in range(60)}, 100: 100, 101: 100}


def test_exact_dedup_grace_recursion():
    records = [(f"{i % 300}".encode().rjust(32, b"0"), f"c{i % 300}".encode() * 50, i, i, 1) for i in range(3000)]
    import hashlib

    records = [(hashlib.sha256(c).digest(), c, n, k, s) for _, c, n, k, s in records]
    out = list(exact_dedup.grace(iter(records), limit=4000))
    assert len(out) == 300 and all(e[4] == 10 for e in out) and sorted(e[3] for e in out) == list(range(2700, 3000))


def test_exact_dedup(hard, hard_rows, empty, clashing, spark):
    got = {r["doc_id"]: r for r in exact_dedup.exact_dedup(hard).collect()}
    assert (got[0]["keep_id"], got[0]["group_size"]) == (2, 3)  # null, empty and white space; the longest original stays
    assert got[8]["keep_id"] == 12 and got[16]["keep_id"] == 16 and not got[17]["kept"]
    assert exact_dedup.exact_dedup(empty).count() == 0 and exact_dedup.drop_copies(empty).count() == 0
    kept = exact_dedup.drop_copies(clashing)
    assert kept.columns == clashing.columns
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == sorted(i for i, r in got.items() if r["kept"])
    twice = spark.createDataFrame([(1, "a b", None, None, 1), (1, "a b", None, None, 1), (2, "ab", None, None, 1), (None, "z", None, None, 1)], SCHEMA)
    assert sorted((r["doc_id"] or -1) for r in exact_dedup.drop_copies(twice).collect()) == [-1, 1]


def test_exact_dedup_of_a_hot_text(spark, monkeypatch):
    """Half of all rows have one text: its rows are dealt over slices; ids that repeat or are missing stay right."""
    from promptquarry.llm import keyfilter

    monkeypatch.setattr(keyfilter, "SLICE", 20)
    monkeypatch.setattr(keyfilter, "HOT_SHARE", 30)
    rows = [(i, "same text" if i % 2 else f"text {i // 3}") for i in range(400)] + [(7, "other"), (7, "text 2"), (None, "same text"), (None, "lone")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    classes = {}
    for i, t in rows:
        classes.setdefault("".join(t.split()), []).append((-len(t), i is None, i))
    expected = sorted(((i, min(classes["".join(t.split())])[2], len(classes["".join(t.split())])) for i, t in rows), key=str)
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"]) for r in exact_dedup.exact_dedup(df).collect()), key=str) == expected
    kept = sorted((min(c)[2] for c in classes.values()), key=str)
    assert sorted((r["doc_id"] for r in exact_dedup.drop_copies(df).collect()), key=str) == kept


def test_substring_dedup_of_hot_passages(spark, monkeypatch):
    """A passage in many contexts, in small blocks, parts of two levels and with hot pieces."""
    for name, value in {"MOST_PARTS": 3, "PART_BYTES": 2000, "HOT_SHARE": 20, "BLOCK_WINDOWS": 500, "KEYS_PER_BUCKET": 300, "RUN_BYTES": 3000}.items():
        monkeypatch.setattr(substring_dedup, name, value)
    r = random.Random(8)
    hot = "".join(r.choices("abcdef", k=70))
    noise = lambda: "".join(r.choices("abcdef", k=r.randrange(0, 90)))
    rows = [(i, noise() + hot[r.randrange(0, 20) :] + noise() + (hot if i % 3 else "é" * 9)) for i in range(200)]
    got = {x["doc_id"]: tuple(x)[1:5] for x in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 40, 16).collect()}
    assert got == dict(zip([i for i, _ in rows], brute.repeats(rows, 40)))


def test_a_text_beyond_the_positions_is_refused(monkeypatch):
    monkeypatch.setattr(substring_dedup, "POSITION_BITS", 9)
    with pytest.raises(ValueError, match="positions"):
        substring_dedup.anchors([b"x" * 600])


def test_rows_without_keys(spark, monkeypatch):
    """Broadcast or through a bitmap: the same rows stay, those without a key too."""
    from pyspark.sql import functions as F

    from promptquarry.llm import keyfilter

    rows = spark.createDataFrame([(i if i % 10 else None, f"t{i}") for i in range(300)], "doc_id long, text string").repartition(3)
    gone = spark.createDataFrame([(i,) for i in range(0, 300, 7)], "doc_id long")
    want = sorted(f"t{i}" for i in range(300) if i % 10 == 0 or i % 7)
    for most in (1000, 0):
        monkeypatch.setattr(keyfilter, "BROADCAST_KEYS", most)
        left = keyfilter.without(rows, F.col("doc_id"), gone)
        assert sorted(r["text"] for r in left.collect()) == want and left.columns == rows.columns


def test_near_dedup_in_slices(spark, hard, hard_rows, monkeypatch):
    """Keys and nodes of more than four rows are hot here; the groups stay the same."""
    from promptquarry.llm import keyfilter

    monkeypatch.setattr(keyfilter, "SLICE", 4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.groups(hard).collect()}
    assert got == brute.near([(r[0], r[1]) for r in hard_rows])
    star = spark.createDataFrame([(0, i) for i in range(1, 200)] + [(i, 300) for i in range(150, 200)] + [(400, 401)], "u long, v long")
    assert {tuple(r) for r in connected_components(star).collect()} == {(i, 0) for i in [*range(200), 300]} | {(400, 400), (401, 400)}


def test_joined_in_slices(spark, monkeypatch):
    from pyspark.sql import functions as F

    from promptquarry.llm import keyfilter

    monkeypatch.setattr(keyfilter, "SLICE", 10)
    rows = spark.createDataFrame([(1, i) for i in range(95)] + [(2, i) for i in range(10)] + [(3, 0), (None, 1)], "k long, v long")
    per = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("top"))
    out = keyfilter.joined_in_slices(rows, per, "k", "n", 106, "v")
    assert out.columns == ["k", "v", "n", "top"]
    assert sorted(tuple(r) for r in out.collect()) == [(1, i, 95, 94) for i in range(95)] + [(2, i, 10, 9) for i in range(10)] + [(3, 0, 1, 0)]
