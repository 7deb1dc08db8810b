"""Every query with SQL against DuckDB on the smallest test tables; llm queries too where the subpackage is there."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET TimeZone='UTC'")
    for f in os.listdir(FOLDER):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{FOLDER}/{f}')")
    return c


def rows(df):
    def form(v):
        if hasattr(v, "tolist"):
            v = v.tolist()
        if v is None or not hasattr(v, "__len__") and pd.isna(v):
            return ""
        return f"{v:.6g}" if isinstance(v, float) else str(v)

    df = df[sorted(df.columns)]
    return list(df.columns), sorted(tuple(map(form, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    assert rows(entry.queries()[name](spark, FOLDER).toPandas()) == rows(duck.sql(entry.oracle_sql()[name]).df())


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
