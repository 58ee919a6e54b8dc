"""Queries of this subpackage that SQL can express, held against it on whole tables."""

import math
import os

import pytest

from lodeframe.llm import registry

DATA = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, name):
    con = pytest.importorskip("duckdb").connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = registry.queries()[name](spark, DATA)
    result = con.execute(registry.oracle_sql()[name])
    columns = sorted(d[0] for d in result.description)
    assert sorted(df.columns) == columns
    at = [[d[0] for d in result.description].index(c) for c in columns]
    whole = lambda row: tuple(v if not isinstance(v, float) else None for v in row)
    expected = sorted((tuple(r[i] for i in at) for r in result.fetchall()), key=repr)
    found = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    assert len(found) == len(expected)
    for a, b in zip(sorted(found, key=lambda r: repr(whole(r))), sorted(expected, key=lambda r: repr(whole(r))), strict=True):
        assert whole(a) == whole(b)
        assert all(math.isclose(x, y, rel_tol=1e-9) for x, y in zip(a, b, strict=True) if isinstance(x, float))
