"""Every checked query against its SQL twin on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as driver
from tools.compare import canonical, kinds

QUERIES, ORACLES = driver.queries(), driver.oracle_sql()


@pytest.fixture(scope="module")
def engine(data):
    con = duckdb.connect()
    for f in os.listdir(data):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{data}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, engine, data, name):
    df = QUERIES[name](spark, data)
    got = df.toPandas()
    if name not in ORACLES:
        assert len(got.columns) > 0
        return
    rel = engine.execute(ORACLES[name])
    types = [(d[0], str(d[1])) for d in rel.description]
    want = rel.fetch_df()
    assert kinds(df.dtypes) == kinds(types)
    assert len(got) == len(want)
    a, b = canonical(got), canonical(want)
    assert a.equals(b), (a[(a != b).any(axis=1)].head(), b[(a != b).any(axis=1)].head())


def test_entry(spark):
    assert driver.entry(spark).count() == 5
