"""Every query with SQL against DuckDB on the smallest tables."""

import os
from collections import Counter

import pandas as pd
import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")
from seqloom import plans  # noqa: E402


@pytest.fixture(scope="module")
def oracle(data):
    c = duckdb.connect()
    for f in os.listdir(data):
        path = os.path.join(data, f)
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return c


def rows(df):
    df = df[sorted(df.columns)]
    plain = lambda v: None if pd.isna(v) else repr(round(float(v), 9)) if isinstance(v, float) else str(v)
    return Counter(tuple(plain(v) for v in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_equals_sql(spark, data, oracle, name):
    got, want = plans.QUERIES[name](spark, data).toPandas(), oracle.sql(plans.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
