"""Queries of the subpackage that SQL expresses give the rows that DuckDB gives."""

import duckdb
import pytest

from lattica.llm import queries

TABLES = "documents pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = queries.queries()[name](spark, sf)
    found = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(got.columns)
    want = sorted(tuple(str(r[names.index(c)]) for c in got.columns) for r in found.fetchall())
    assert sorted(tuple(map(str, r)) for r in got.collect()) == want
