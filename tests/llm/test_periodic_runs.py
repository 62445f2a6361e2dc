"""op13 against a search of every period at every place."""

import hashlib
import random
import time
import zlib

from pyspark.sql import functions as F

from promptquarry.llm import queries
from promptquarry.llm.periodic_runs import find_runs, periodic_runs
from promptquarry.llm.common import table
from tests.llm import brute
from tests.llm.conftest import SCHEMA


def plain_runs(w):
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            e = i + q
            if e - s >= max(6, 4 * q) and not any(all(w[k] == w[k + r] for k in range(s, e - r)) for r in range(1, q)):
                out.append((s, e - s, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    w = brute.WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(w), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha(lines), sha(kept))


def key(row):
    return tuple((x is not None, x) for x in row)


def test_random_words():
    r = random.Random(7)
    for _ in range(400):
        docs = []
        for _ in range(r.randint(1, 5)):
            n, k = r.randint(0, 60), r.choice([1, 2, 2, 3, 5])
            w = [b"%d" % r.randrange(k) for _ in range(n)]
            if r.random() < 0.6 and n:
                a = r.randrange(n)
                p = 1 + r.randrange(max(1, (n - a) // 3))
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            docs.append(w)
        assert find_runs(docs) == [plain_runs(d) for d in docs]


def test_long_runs_take_linear_work():
    for words, expected in (([b"a"] * 50_000, [(0, 50_000, 1)]), ([b"a", b"b", b"a"] * 30_000, [(0, 90_000, 3)])):
        began = time.time()
        assert find_runs([words]) == [expected] and time.time() - began < 20


def test_query(spark, tmp_path, hard):
    """All columns, with nulls, empty and long texts, copies, documents that end periodically and a column named runs."""
    more = spark.range(100, 400).select(F.col("id").alias("doc_id"), F.concat_ws("  ", F.array_repeat(F.concat(F.lit("w"), F.col("id") % 7), (F.col("id") % 40).cast("int")), F.lit("x y  z\n")).alias("text"))
    rows = hard.unionByName(more, allowMissingColumns=True).unionByName(spark.createDataFrame([(None, "a b a b a b a b", None, None, None), (5, "a b a b a b a b c", None, None, None)], SCHEMA))
    rows.withColumns({"runs": F.lit(1), "collapsed": F.lit("x"), "start": F.lit(2)}).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_periodic_runs(spark, str(tmp_path)).collect()
    expected = [plain_row(r["doc_id"], r["text"]) for r in rows.collect()]
    assert sorted(map(tuple, got), key=key) == sorted(expected, key=key)
    assert sum(r["n_runs"] > 0 for r in got) > 20


def test_whole_table(spark, sf_dir):
    """Texts below 1,500 words of a small table against the plain search; the others give a row each."""
    docs = table(spark, sf_dir, "documents")
    got = {r["doc_id"]: tuple(r) for r in queries.op13_periodic_runs(spark, sf_dir).collect()}
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert set(got) == {d for d, _ in rows}
    for d, text in rows:
        if len(text or "") < 3_000:
            assert got[d] == plain_row(d, text)


def test_empty_and_spans(spark, empty):
    assert periodic_runs(empty).collect() == []
    own = spark.createDataFrame([(1, "x " + "a b " * 5 + "a y")], "doc_id long, text string")
    row = periodic_runs(own).first()
    assert [tuple(r) for r in row["runs"]] == [(1, 11, 2)] and row["collapsed"] == "x a b y"
