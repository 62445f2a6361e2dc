import math

import pytest
from pyspark.sql import functions as F

from promptquarry.llm import decontamination, keycounts, language_id, lm_scoring, mixing, secrets, token_counts, warc
from promptquarry.llm.common import table
from tests.llm import brute
from tests.llm.conftest import SCHEMA, prose


def test_leaks(spark, hard, hard_rows):
    items = [(1, prose(2, 150)), (2, prose(3, 120)), (3, None), (4, "  "), (5, "one two three"), (6, prose(99, 40))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontamination.leaks(hard, bench).collect()}
    want = brute.leaks([(r[0], r[1]) for r in hard_rows], items)
    assert got.keys() - {(k, 5) for k, _ in got} == want.keys() - {(k, 5) for k, _ in want}
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want) and {(4, 5), (5, 5)} <= got.keys()


def test_leaks_in_tables(spark, sf_dir):
    docs, bench = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(docs, bench).collect()}
    rows = lambda df, k: [(r[k], r["text"]) for r in df.select(k, "text").collect()]
    assert got == brute.leaks(rows(docs, "doc_id"), rows(bench, "item_id")).keys()


def test_leaks_edges(spark, hard, empty, clashing):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.leaks(hard, bench).count() == 0
    some = spark.createDataFrame([(1, prose(3, 120))], "item_id long, text string")
    assert decontamination.leaks(empty, some).count() == 0
    kept = decontamination.drop_leaks(clashing, some)
    assert kept.columns == clashing.columns and kept.count() == clashing.count() - 4


def test_blocks_find_all_within_the_radius():
    """Fingerprints at every distance up to the radius, also with their errors dealt evenly; few others meet."""
    import numpy as np

    r = np.random.default_rng(4)
    items = [(i, r.integers(0, 1 << 63, 40, dtype=np.uint64)) for i in range(60)]
    group = decontamination.Group(40, items)
    blocks, width = decontamination.BLOCKS, decontamination.BLOCK_BITS
    rows, want = [], []
    for d in range(decontamination.RADIUS + 1):
        for spread in (r.permutation(blocks * width)[:d], np.arange(d) % blocks * width + np.arange(d) // blocks):
            own = group.prints[d].copy()
            for at in spread:
                own[at // width] ^= np.uint16(1 << at % width)
            rows.append(own)
            want.append((len(rows) - 1, d))
    assert set(want) <= {(int(w), int(i)) for w, i in group.within_radius(np.stack(rows))}
    # windows of random shingles, an even number, whose votes tie often
    random = decontamination.fingerprints(r.integers(0, 1 << 63, 20 * 2000, dtype=np.uint64), np.arange(2000) * 20, 20)
    assert sum(len(w) for w, _ in group.met(random)) < 0.36 * 2000 * len(items)


def test_long_text_and_many_items_of_one_length(monkeypatch):
    """Pairs are held in runs; the runs' size doesn't change what is found."""
    text = prose(8, 3000, 900).encode()
    words = text.split()
    items = [(i, b" ".join(words[7 * i : 7 * i + 24])) for i in range(300)]
    whole = sorted(decontamination.Index(items).matches([text]))
    monkeypatch.setattr(decontamination, "CODES", 500)
    index = decontamination.Index(items)
    held = []
    group = index.groups[0][1]
    met = group.met
    group.met = lambda prints: (held.append(len(w)) or (w, i) for w, i in met(prints))
    assert sorted(index.matches([text])) == whole and {r[1] for r in whole} == set(range(300))
    assert max(held) <= 500 + 300 and len(held) > 50


def test_leaks_in_blocks_of_the_benchmark(spark, hard, monkeypatch):
    items = [(1, prose(2, 150)), (2, prose(3, 120)), (5, "one two three"), (6, prose(99, 40))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, decontamination.leaks(hard, bench).collect()))
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", 100)
    assert sorted(map(tuple, decontamination.leaks(hard, bench).collect())) == whole and whole


def test_language_of_held_out_rows(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = language_id.identify(language_id.document_evidence(docs.withColumn("true", F.col("lang")).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, F.col("lang"))))).filter("doc_id % 2 = 1")
    right = rows.filter(F.col("true") == F.col("__language")).count()
    assert right >= 0.97 * rows.count()


def test_posteriors(spark, hard, hard_rows, sf_dir):
    small = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source").orderBy("doc_id").limit(120).collect()]
    for rows in ([r[:4] for r in hard_rows], [(i, t, None if i % 4 == 0 else d, None if i % 7 == 0 else s) for i, t, d, s in small]):
        want = brute.languages(rows, language_id.trigrams)
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
        got = {r["doc_id"]: (r["__language"], r["__posterior"]) for r in language_id.identify(language_id.document_evidence(df)).collect()}
        assert got.keys() == want.keys()
        assert all(abs(got[i][1] - want[i][1]) < 1e-4 for i in want)
        assert all(got[i][0] == want[i][0] for i in want if abs(want[i][1] - 0.5) > 1e-3)


def test_language_of_pages(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    said = F.regexp_extract("html", 'lang="([a-z]+)"', 1)
    rows = language_id.identify(language_id.page_evidence(pages.withColumn("said", said)))
    assert rows.filter(F.col("said") == F.col("__language")).count() >= 0.95 * rows.count()


def test_language_edges(spark, hard, empty, clashing):
    got = {r["doc_id"]: r["__language"] for r in language_id.identify(language_id.document_evidence(hard)).collect()}
    assert len(got) == hard.count() and got[0] == got[1] == got[2] == "und"
    assert language_id.identify(language_id.document_evidence(empty)).count() == 0
    assert language_id.keep_identified(clashing).columns == clashing.columns
    nothing = hard.withColumn("lang", F.lit(None).cast("string"))
    assert language_id.keep_identified(nothing).count() == 0


def test_warc_round_trip(spark, sf_dir, duck):
    from promptquarry.llm.queries import OP5_SQL, op5_warc
    from tests.conftest import canonical

    assert canonical(op5_warc(spark, sf_dir).toPandas()) == canonical(duck(OP5_SQL))


def test_warc_edges(spark):
    rows = [(1, "http://a/ b\n", None), (2, None, ""), (3, "http://c", "<p>é</p>"), (5, "http://d", "<p>é</p>"), (5, "http://d", "<p>é</p>"), (None, "u", "x"), (7, "u", "y" * 200_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("file", F.lit("clash")).repartition(2)
    index = warc.write_archives(pages)
    got = warc.read_records(index, with_payload=True).collect()
    by = {}
    for r in got:
        by.setdefault(r["page_id"], []).append(r)
    assert len(got) == 7 and by[1][0]["record_type"] == "revisit" and by[1][0]["refers_to"] == 2
    assert by[1][0]["url"] == "http://a/%20b%0A" and by[2][0]["url"] is None and by[2][0]["payload_bytes"] == 0
    assert by[3][0]["refers_to"] == 5 and [r["record_type"] for r in by[5]] == ["response"] * 2
    assert bytes(by[7][0]["payload"]) == b"y" * 200_000 and by[None][0]["record_type"] == "response"
    assert warc.read_records(index.filter("page_id = 3")).count() == 1
    assert {r["record_type"] for r in warc.archive_round_trip(pages, min_revisit_bytes=1000).collect()} == {"response"}
    assert warc.archive_round_trip(pages.filter("false")).count() == 0


def test_warc_of_hot_pages(spark, monkeypatch):
    """One payload on a third of the pages, others twice or once; many read tasks."""
    monkeypatch.setattr(warc, "HOT_SHARE", 4)
    monkeypatch.setattr(warc, "PART_RECORDS", 20)
    rows = [(i, f"http://h/{i}", "hot" if i % 3 == 0 else f"page {i // 2 if i % 5 else i}") for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = warc.archive_round_trip(pages)
    last = {}
    for i, _, html in rows:
        last[html] = max(i, last.get(html, 0))
    assert {r["page_id"]: r["refers_to"] for r in got.collect()} == {i: None if last[h] == i else last[h] for i, _, h in rows}
    assert got.rdd.getNumPartitions() == 10


def test_token_counts(spark, hard, hard_rows, empty, clashing):
    encoding, _ = token_counts.encoder(token_counts.VOCABULARY, token_counts.PATTERN)
    got = {r["doc_id"]: (r["n_tokens"], r["n_sections"], r["n_crossing"], r["n_outside"], r["section_tokens"]) for r in token_counts.attribute_tokens(hard).collect()}
    short = [r for r in hard_rows if len(r[1] or "") < 6000]
    assert {r[0]: got[r[0]] for r in short} == {r[0]: brute.sections_of(r[1], encoding) for r in short} and len(got) == len(hard_rows)
    again = {r["doc_id"]: r["n_tokens"] for r in token_counts.attribute_tokens(clashing).collect()}
    assert token_counts.attribute_tokens(empty).count() == 0 and again == {i: x[0] for i, x in got.items()}


def test_token_counts_of_lines_and_given_sections(spark):
    """Sections with gaps, boundaries inside words, characters and runs of white space."""
    import random

    r = random.Random(12)
    encoding, _ = token_counts.encoder(token_counts.VOCABULARY, token_counts.PATTERN)
    rows = []
    for i in range(80):
        text = "".join(r.choice(["wording ", "é", "\n", "\n\n", "  ", "日本語", "12345", "🙂", "un", "-->"]) for _ in range(40))
        cuts = sorted(r.sample(range(len(text) + 1), 6))
        rows.append((i, text, [(a, b) for a, b in zip(cuts[::2], cuts[1::2])]))
    df = spark.createDataFrame([(i, t, [{"start": a, "end": b} for a, b in s]) for i, t, s in rows], "doc_id long, text string, s array<struct<start:int,end:int>>")
    for sections in (None, "s"):
        got = {x["doc_id"]: tuple(x)[1:] for x in token_counts.attribute_tokens(df, sections=sections).collect()}
        assert got == {i: brute.sections_of(t, encoding, s if sections else None) for i, t, s in rows}


def test_token_attribution_rule(spark):
    import numpy as np

    ends = np.array([4, 10, 12, 20])
    starts, stops = np.array([0, 6, 11]), np.array([6, 11, 18])
    # the second token has 2 bytes before and 4 after the boundary at 6, the third one lies half on either side of 11
    counts, crossing, outside = token_counts.attribute(ends, starts, stops)
    assert counts.tolist() == [1, 2, 1] and crossing == 3 and outside == 0
    df = spark.createDataFrame([(1, "ab é cd", [{"start": 0, "end": 4}, {"start": 5, "end": 7}])], "doc_id long, text string, s array<struct<start:int,end:int>>")
    r = token_counts.attribute_tokens(df, sections="s").first()
    assert sum(r["section_tokens"]) + r["n_outside"] == r["n_tokens"]


@pytest.mark.parametrize("weights", [(3.0, 1.0, 2.0), (1.0,), (0.5, 9.0)])
def test_mixing(spark, hard, weights):
    rows = mixing.mix(hard, weights=weights).collect()
    sizes, targets, taken = {}, {}, {}
    for r in rows:
        sizes[r["source"]], targets[r["source"]] = r["__source_size"], r["__target"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["__taken"]
        assert 0 <= r["__taken"] <= 2 * r["__size"]
    total = sum(sizes.values())
    assert abs(sum(targets.values()) - 1.5 * total) < 1e-6 * total
    assert all(taken[s] == math.floor(targets[s]) for s in sizes) and all(targets[s] <= 2 * sizes[s] + 1e-9 for s in sizes)


def test_mixing_edges(spark, hard, empty, clashing):
    assert mixing.mix(empty).count() == 0 and mixing.mixed_rows(empty).count() == 0
    once, again = ([tuple(r) for r in mixing.mix(df.select("doc_id", "source", "text")).orderBy("doc_id").collect()] for df in (hard, hard.repartition(7)))
    assert once == again
    rows = mixing.mixed_rows(clashing)
    assert rows.agg(F.sum("taken")).first()[0] == mixing.mix(hard).agg(F.sum("__taken")).first()[0]
    assert mixing.mix(spark.createDataFrame([(1, None, None, "a", 0)], SCHEMA)).first()["__target"] == 0.0


def test_key_counts(spark):
    import numpy as np

    keys = np.unique(np.random.default_rng(2).integers(0, 1 << 64, 500, dtype=np.uint64))
    counts = np.ones((1, len(keys)), np.uint32)
    asked = spark.createDataFrame(keycounts.requests(1, keys, counts, 7)).union(spark.createDataFrame(keycounts.requests(2, keys[::2].copy(), counts[:, ::2].copy(), 7)))
    rows = keycounts.answered(asked).collect()
    got = keycounts.gathered([(r["bucket"], r["totals"]) for r in rows if r["block"] == 1], 1)[0]
    assert got.tolist() == [2 - i % 2 for i in range(len(keys))]


def test_lm_scores(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = lm_scoring.score(docs).collect()
    want = brute.base_scores([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    for r in rows:
        w = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:4] and abs(r["base_score"] - w[4]) < 1e-6 * abs(w[4])
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(want) and sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_lm_scores_and_weights(spark, hard, hard_rows):
    """The model's own score against a plain version, on few rows and on a table's."""
    words = [prose(i, 30 + i % 50, 60) for i in range(150)]
    for rows, df in (([(r[0], r[1]) for r in hard_rows], hard), (list(enumerate(words)), spark.createDataFrame(list(enumerate(words)), "doc_id long, text string").repartition(3))):
        want, weights = brute.lm_scores(rows)
        got = {r["doc_id"]: r["score"] for r in lm_scoring.score(df).collect()}
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-6 * max(1, abs(want[i])) for i in want)
        assert all(abs(sum(w) - 1) < 1e-9 for w in weights.values())


def test_lm_edges(spark, hard, empty, clashing):
    assert lm_scoring.score(empty).count() == 0
    rows = {r["doc_id"]: r for r in lm_scoring.score(clashing).collect()}
    assert len(rows) == hard.count() and rows[0]["n_tokens"] == 1 and all(r["score"] < 0 for r in rows.values())
    one = spark.createDataFrame([(None, "a a"), (None, None)], "doc_id long, text string")
    assert sorted(r["n_tokens"] for r in lm_scoring.score(one).collect()) == [1, 3]


def test_secrets(hard, hard_rows, empty, clashing):
    import hashlib

    got = {r["doc_id"]: r for r in secrets.secret_spans(hard).collect()}
    for doc_id, text, *_ in hard_rows:
        want = brute.secret_spans(text)
        assert got[doc_id]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(got[doc_id]["spans"].split(","))
    assert got[20]["n_assign"] == got[20]["n_access"] == got[20]["n_hex"] == 1 and got[21]["n_assign"] == 0
    assert secrets.secret_spans(empty).count() == 0 and secrets.secret_spans(clashing).count() == clashing.count()


def test_entropy_by_increments(spark):
    values = ["abcdefghijklmnopqrst", "a" * 30, "aB3dE5gH7jK9mN1pQ2sTaB3d", "0123456789abcdef0123456789abcdef"]
    df = spark.createDataFrame([(v,) for v in values], "v string").select("v", secrets.best_entropy(F.col("v")).alias("h"))
    for r in df.collect():
        assert abs(r["h"] - max(brute.entropies(r["v"]))) < 1e-9


def test_long_candidates(spark):
    """Work grows with the length of a candidate."""
    import random
    import string
    import time

    r = random.Random(6)
    long = "".join(r.choices(string.ascii_letters + string.digits + "+/", k=200_000))
    df = spark.createDataFrame([(1, "see " + long + " end"), (2, "z" * 200_000 + "+"), (3, "short")], "doc_id long, text string")
    start = time.time()
    got = {x["doc_id"]: x["spans"] for x in secrets.secret_spans(df).collect()}
    assert got == {1: "entropy:4:200004", 2: "", 3: ""} and time.time() - start < 60


def test_allow_list(spark):
    values = {"123e4567-e89b-12d3-a456-426614174000": False, "some-long-kebab-case-name-here": False, "kT9xQ2vLmZ8wRb4yNc7uJd1sG5hF0pA3": True, "00000000000000000000000000": False}
    df = spark.createDataFrame([(v,) for v in values], "v string").select("v", secrets.is_secret(F.col("v")).alias("s"))
    assert {r["v"]: r["s"] for r in df.collect()} == values
