"""Every registered query against its SQL in DuckDB."""

import pytest

from promptquarry import registry
from tests.conftest import canonical


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(name, spark, sf_dir, duck):
    got = registry.queries()[name](spark, sf_dir).toPandas()
    assert canonical(got) == canonical(duck(registry.oracle_sql()[name]))


def test_every_query_without_sql_is_known():
    assert set(registry.queries()) - set(registry.oracle_sql()) == {"bm25_topk_porter"}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
