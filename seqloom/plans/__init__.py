"""Queries of this library and the SQL they are held against."""

from seqloom.plans import dealt, file_queries, region_queries, sequence_queries

_PARTS = (dealt, sequence_queries, region_queries, file_queries)
QUERIES = {k: v for p in _PARTS for k, v in p.QUERIES.items()}
SQL = {k: v for p in _PARTS for k, v in p.SQL.items()}
