"""Every engine query against its SQL on the smallest tables."""

import os

import pytest

from lodeframe import more_queries, queries

DATA = "/root/testdata/sf0.001"
assert more_queries


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6) + 0.0
    if hasattr(v, "as_tuple"):
        return round(float(v), 6)
    if hasattr(v, "isoformat"):
        return v.isoformat()[:19]
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def oracle():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in queries.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, oracle, name):
    df = queries.queries()[name](spark, DATA)
    result = oracle.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    order = sorted(columns)
    expected = sorted((tuple(plain(r[columns.index(c)]) for c in order) for r in result.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr) == expected


def test_entry_imports():
    import __spark_entry__

    assert set(queries.queries()) <= set(__spark_entry__.queries())
