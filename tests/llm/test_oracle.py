"""Queries with SQL give the same rows in DuckDB."""

import duckdb
import pytest

from periodlens.llm import queries as Q

from ..conftest import SF_SMALL

TABLES = "documents pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_SMALL}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_equal(spark, con, name):
    got = Q.QUERIES[name](spark, SF_SMALL)
    want = con.execute(Q.SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got.select(*columns).collect()), key=key) == \
        sorted(want.fetchall(), key=key)


def test_one_query_per_operator():
    numbers = sorted(int(n[2:].split("_")[0]) for n in Q.QUERIES)
    assert numbers == list(range(1, 14))
