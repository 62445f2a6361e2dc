import os
from collections import Counter

import corpus_pipeline
import pytest

from promptquarry.llm import common, language_id, queries
from promptquarry.llm.common import table
from tests.conftest import canonical
from tests.llm import brute


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(name, spark, sf_dir, duck):
    assert canonical(queries.queries()[name](spark, sf_dir).toPandas()) == canonical(duck(queries.oracle_sql()[name]))


def test_stages(spark, sf_dir, tmp_path):
    """Each stage against brute force on what the one before it kept."""
    docs = table(spark, sf_dir, "documents")
    columns = docs.columns
    rows = lambda df: {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}
    start = docs.collect()
    items = [(r["item_id"], r["text"]) for r in table(spark, sf_dir, "benchmark").collect()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = rows(docs)
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        after = rows(docs)
        if name == "language":
            found = brute.languages([(r["doc_id"], r["text"], r["lang"], r["source"]) for r in start], language_id.trigrams)
            assert set(after) == {d for d, (language, _) in found.items() if language != "und"}
        elif name == "exact":
            own = {}
            for d, t in before.items():
                key = "".join(t.split())
                own[key] = min(own.get(key, (0, d)), (-len(t), d))
            assert set(after) == {d for _, d in own.values()}
        elif name == "near":
            assert set(after) == {d for d, (_, c) in brute.near(before.items(), 80).items() if d == c}
        elif name == "decontaminate":
            assert set(after) == set(before) - {d for d, _ in brute.leaks(before.items(), items)}
        assert name == "mix" or docs.columns == columns
        if name == "mix":
            taken = Counter()
            for r in docs.select("doc_id", "taken").collect():
                taken[r["doc_id"]] += r["taken"]
            assert dict(taken) == {d: k for d, k in brute.mix(mixed).items() if k}
        mixed = [(r["doc_id"], r["text"], r["source"]) for r in docs.select("doc_id", "text", "source").collect()] if name == "decontaminate" else None
    assert {"epoch", "taken"} <= set(docs.columns)


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() > 0 and out.filter("taken <= 0").count() == 0
    written = list(common._SCRATCH)
    common.clear_scratch(spark)
    assert written and not any(os.path.exists(p.removeprefix("file://")) for p in written)
