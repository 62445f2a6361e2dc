import pytest
from pyspark.sql import functions as F

from promptquarry.llm import mixing


@pytest.mark.parametrize("i", [None, 7])
@pytest.mark.parametrize("n", [1, 2, 9, 50])
def test_tied_rows_meet_the_target(spark, i, n):
    """Rows of one key, id and size: each is decided by itself."""
    rows = [(i, "a", "one two three four %d" % (k // 2)) for k in range(n)] + [(100 + k, "b", "w " * 40) for k in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(3)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    for s in ("a", "b"):
        own = [r for r in got if r["source"] == s]
        assert sum(r["__taken"] for r in own) == int(own[0]["__target"])
        assert sum(r["__taken"] % r["__size"] != 0 for r in own) <= 1
    assert mixing.mixed_rows(df).agg(F.sum("taken")).first()[0] == sum(r["__taken"] for r in got)
