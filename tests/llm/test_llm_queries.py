"""Queries of the llm package with SQL against DuckDB on the smallest tables."""

import os
from collections import Counter

import pytest

from seqloom.llm import queries

duckdb = pytest.importorskip("duckdb")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, data, name):
    c = duckdb.connect()
    for f in os.listdir(data):
        path = os.path.join(data, f)
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    got, want = queries.QUERIES[name](spark, data).toPandas(), c.sql(queries.SQL[name]).df()
    got, want = got[sorted(got.columns)], want[sorted(want.columns)]
    assert list(got.columns) == list(want.columns)
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    assert Counter(tuple(map(plain, r)) for r in got.itertuples(index=False)) == Counter(tuple(map(plain, r)) for r in want.itertuples(index=False))
