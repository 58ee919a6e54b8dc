"""Builder, keys, records, lookups, money, streams."""

import pytest
from pyspark.sql import functions as F

from lodeframe.builder import collection, collection_group
from lodeframe.errors import AlreadyExistsError, NotFoundError, QueryError, UnsupportedError
from lodeframe.functions.keys import escape_id, key, key_column
from lodeframe.functions.money import divided, money_avg, money_sum
from lodeframe.operators.lookup import enrich, lookup, lookup_pages
from lodeframe.plans.run import run, to_frame
from lodeframe.sources.capabilities import capabilities, is_capability_aware, require
from lodeframe.sources.catalog import Catalog
from lodeframe.sources.records import Session, keyed


def test_keys(spark):
    k = key("shop", "a/b").child("item", 7)
    assert k.path == "shop/a%2Fb/item/7" and k.collection_path == "shop/a%2Fb/item"
    assert escape_id("50%.x") == "50%25%2Ex"
    df = spark.createDataFrame([("a/b",), ("50%.x",)], "id string")
    assert [r[0] for r in df.select(key_column("c", F.col("id"))).collect()] == ["c/a%2Fb", "c/50%25%2Ex"]
    with pytest.raises(QueryError):
        key("a/b", 1)


def test_builder(spark):
    df = spark.createDataFrame([(1, "a", [1, 2]), (2, "b", [3]), (3, None, None), (4, "a", [2])], "id int, g string, t array<int>")
    take = lambda q: [r["id"] for r in q.frame(df).collect()]
    assert take(collection("x").where("g", "==", None)) == [3]
    assert take(collection("x").where("t", "array-contains", 2).order_by("id", "desc")) == [4, 1]
    assert take(collection("x").where("t", "array-contains-any", [1, 3]).order_by("id")) == [1, 2]
    assert take(collection("x").where("id", "not-in", [1, 2]).order_by("id").limit(1)) == [3]
    assert take(collection("x").order_by("g").order_by("id").start_after("a", 1)) == [4, 2]
    assert take(collection("x").order_by("g", "desc").order_by("id").start_at("a", 4)) == [4, 3]
    assert take(collection("x").order_by("id").end_before(3)) == [1, 2]
    assert collection_group("x").build()["source"] == {"kind": "group", "name": "x"}
    for bad in (lambda: collection("x").limit(0), lambda: collection("x").where("a", "~", 1), lambda: collection("x").start_at(1), lambda: collection("")):
        with pytest.raises(QueryError):
            bad()


def test_records(spark):
    df = keyed(spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string"), "x", "id")
    s = Session(df)
    assert s.get(key("x", 1))["v"] == "a" and s.get(key("x", 9)) is None
    many = s.get_many([key("x", 2), key("x", 9), key("x", 1)]).collect()
    assert [(r["v"], r["_exists"]) for r in many] == [("b", True), (None, False), ("a", True)]
    new = keyed(spark.createDataFrame([(2, "B"), (3, "c")], "id int, v string"), "x", "id")
    with pytest.raises(AlreadyExistsError):
        s.insert(new)
    for write in (s.insert, s.set):
        with pytest.raises(AlreadyExistsError):
            write(keyed(spark.createDataFrame([(7, "x"), (7, "y")], "id int, v string"), "x", "id"))
    assert sorted(r["v"] for r in s.set(new).df.collect()) == ["B", "a", "c"]
    assert s.update(key("x", 1), {"v": "z"}).get(key("x", 1))["v"] == "z"
    assert s.delete([key("x", 1)]).df.count() == 1
    with pytest.raises(NotFoundError):
        s.require(key("x", 5))
    with pytest.raises(UnsupportedError):
        s.transaction()


def test_lookups(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "id int, k string")
    out = lookup(df, lambda r: r["k"], lambda k: k * 2, lambda r, v: {"id": r["id"], "v": v}, "id int, v string", concurrency=4)
    assert sorted((r["id"], r["v"]) for r in out.collect()) == [(1, "aa"), (2, None), (3, "bb")]
    dim = spark.createDataFrame([("a", 5)], "name string, x int")
    for size in (0, 1 << 30):
        assert sorted((r["id"], r["x"]) for r in enrich(df, dim, {"k": "name"}, most_bytes=size).collect()) == [(1, 5), (2, None), (3, None)]
    with pytest.raises(QueryError):
        lookup(df, len, len, dict, "id int", concurrency=65)
    same = spark.createDataFrame([(8, "a")], "id int, k string")
    assert [(r["id"], r["id_2"]) for r in enrich(df, same, {"k": "k"}).orderBy("id").collect()] == [(1, 8), (2, None), (3, None)]


def test_lookups_of_pages(spark):
    seen, asked = [], []
    pages = [[{"id": 1, "k": "a"}, {"id": 2, "k": None}, {"id": 3, "k": "a"}], [{"id": 4, "k": "b"}]]
    fetch = lambda k: asked.append(k) or k.upper()
    out = list(lookup_pages(pages, lambda r: r["k"], fetch, lambda r, v: {"id": r["id"], "v": v}, on_progress=seen.append))
    assert out == [[{"id": 1, "v": "A"}, {"id": 2, "v": None}, {"id": 3, "v": "A"}], [{"id": 4, "v": "B"}]]
    assert sorted(asked) == ["a", "b"]
    assert [(p["rows_loaded"], p["requests_completed"], p["requests_pending"]) for p in seen] == [(3, 1, 0), (4, 2, 0)]
    assert list(lookup_pages([], len, len, lambda r, v: r)) == []
    with pytest.raises(ZeroDivisionError):
        list(lookup_pages(pages, lambda r: r["k"], lambda k: 1 // 0, lambda r, v: r))
    with pytest.raises(QueryError):
        list(lookup_pages([[{}] * 1001], lambda r: None, len, lambda r, v: r))


def test_two_databases(spark):
    trade = spark.range(3)
    c = Catalog(spark, resolver=lambda r: trade if r.get("database") == "trade" else None).add("t", spark.range(5), database="people")
    count = lambda **where: to_frame(c, {"from": {"name": "t", "as": "t", **where}, "columns": [{"field": "id"}]}, dialect="J").count()
    assert (count(database="people"), count(database="trade")) == (5, 3)
    for where in ({}, {"database": "other"}):
        with pytest.raises(NotFoundError):
            count(**where)


def test_money(spark):
    df = spark.createDataFrame([("12.05",), ("0.95",), ("100000000000000000",), (None,)], "a string")
    assert df.select(money_sum(F.col("a"), 2).alias("s"), money_avg(F.col("a"), 2, 4).alias("m")).first().asDict() == {"s": "100000000000000013", "m": "33333333333333337.6667"}
    pair = spark.createDataFrame([("5", "16"), ("7", "16"), ("-5", "16"), ("3", "4")], "a string, b string")
    assert [r[0] for r in pair.select(divided(F.col("a"), F.col("b"), 2, 3)).collect()] == ["0.312", "0.438", "-0.312", "0.75"]
    for bad in ("2.345", "abc", "7e3"):
        with pytest.raises(Exception, match="money"):
            spark.createDataFrame([(bad,)], "a string").select(money_sum(F.col("a"), 2)).collect()
    c = Catalog(spark).add_rows("P", [{"g": "x", "a": "0.10"}, {"g": "x", "a": "0.25"}])
    body = {"from": {"name": "P"}, "groupBy": [{"field": "g"}], "columns": [{"field": "g"}, {"aggregate": {"function": "sum", "args": [{"field": "a"}]}, "as": "s"}, {"aggregate": {"function": "avg", "args": [{"field": "a"}]}, "as": "m"}], "money": {"minorUnitScale": 2, "divisionScale": 2, "rounding": "halfEven"}}
    assert run(c, body) == [{"g": "x", "s": "0.35", "m": "0.18"}]


def test_capabilities():
    assert capabilities()["joins"] and not is_capability_aware(3)
    with pytest.raises(UnsupportedError):
        require("transactions")


def test_stream(spark, tmp_path):
    from lodeframe.streaming.pages import stream_enriched, stream_parquet, to_memory

    facts = spark.createDataFrame([(i, i % 2) for i in range(20)], "id int, k int")
    facts.repartition(3).write.parquet(str(tmp_path / "facts"))
    dim = spark.createDataFrame([(0, "even"), (1, "odd")], "k int, name string")
    q = to_memory(stream_enriched(stream_parquet(spark, str(tmp_path / "facts"), facts), dim, {"k": "k"}), "enriched")
    q.awaitTermination()
    assert spark.sql("SELECT count(*) AS n FROM enriched WHERE (id % 2 = 1) = (name = 'odd')").first()["n"] == 20


def test_codecs(spark):
    from lodeframe.functions.codecs import identity_codec, json_codec

    df = spark.createDataFrame([('{"a":1}',)], "v string")
    c = json_codec("v", "a int")
    assert c.decode(df).first()["v"]["a"] == 1 and c.encode(c.decode(df)).first()["v"] == '{"a":1}'
    assert identity_codec().decode(df) is df
