import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SMALL


@pytest.fixture(scope="session")
def duck():
    """Runs DuckDB SQL over the tables of a folder."""
    import duckdb

    def run(query, folder=SMALL):
        con = duckdb.connect()
        con.execute("SET TimeZone='UTC'")
        for f in os.listdir(folder):
            con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{folder}/{f}')")
        return con.sql(query).df()

    return run


def canonical(frame):
    """Rows as sorted tuples of strings, columns by name."""
    import pandas as pd

    def text(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return "NULL"
        v = v.tolist() if hasattr(v, "tolist") else v
        return "[" + ",".join(map(text, v)) + "]" if isinstance(v, list) else repr(round(v, 9)) if isinstance(v, float) else str(v)

    return sorted(frame.columns), sorted(map(tuple, frame[sorted(frame.columns)].map(text).values.tolist()))
