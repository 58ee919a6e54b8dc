"""First, last and null order over whole tables, at a size of many rows."""

import os

import pytest

from lodeframe import queries

DATA = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_first_and_last_of_the_whole_table(spark):
    orders = spark.read.parquet(f"{DATA}/orders.parquet")
    want = {}
    for r in orders.orderBy("o_orderkey").select("o_orderstatus", "o_custkey", "o_orderkey").collect():
        want[r[0]] = (want.get(r[0], (r[1],))[0], r[1], r[2])
    got = {r[0]: (r["first_customer"], r["last_customer"], r["last_key"]) for r in queries.queries()["agg_first_last"](spark, DATA).collect()}
    assert got == want


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_null_order_of_the_whole_table(spark):
    rows = [tuple(r) for r in queries.queries()["order_nulls"](spark, DATA).select("quality", "toxic", "doc_id").collect()]
    assert len(rows) == spark.read.parquet(f"{DATA}/documents.parquet").count() and any(r[0] is None for r in rows)
    assert rows == sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, r[1] or 0, r[2]))
