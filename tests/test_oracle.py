"""Every query with SQL gives the rows that DuckDB gives."""

import os

import duckdb
import pytest

from lattica import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_sql(spark, sf, duck, name):
    got = catalog.queries()[name](spark, sf)
    cols = sorted(got.columns)
    found = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in found.description]
    want = sorted(tuple(str(r[names.index(c)]) for c in cols) for r in found.fetchall())
    assert sorted(names) == cols
    assert sorted(tuple(str(r[c]) for c in cols) for r in got.collect()) == want
