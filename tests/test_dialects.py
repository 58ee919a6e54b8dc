"""Rules of both dialects on small tables, expected rows worked out by hand."""

import math

import pytest

from lodeframe.errors import QueryError, UnsupportedError
from lodeframe.plans.document import parse
from lodeframe.plans.run import bounded, cancellable, check_overflow, observed, pages, run, to_frame
from lodeframe.sources.catalog import Catalog


@pytest.fixture(scope="module")
def tables(spark):
    c = Catalog(spark)
    c.add_rows("Sale", [{"id": 1, "g": "a", "n": 2.0, "d": 0}, {"id": 2, "g": None, "n": None, "d": 2}, {"id": 3, "g": "b", "n": 5.0, "d": 1}, {"id": 4, "g": None, "n": 4.0, "d": 4}])
    c.add_rows("Reading", [{"id": n, "value": v} for n, v in enumerate([3.5, "low", False, None, "high", -2], 1)])
    c.add_rows("A", [{"id": 1}, {"id": 2}])
    c.add_rows("Port", [{"port": 1}, {"port": 2}, {"port": 3}])
    c.add_rows("Ship", [{"ship": 100, "berth": 2}, {"ship": 101, "berth": 2}, {"ship": 102, "berth": 3}])
    c.add_rows("Watch", [{"watch": 20, "at": 1}, {"watch": 21, "at": 2}])
    c.add_rows("Crew", [{"crew": 7, "aboard": 102}])
    c.add_rows("Huge", [{"id": n, "g": g, "x": x} for n, (g, x) in enumerate([("up", 9e307), ("mid", 6e307), ("up", 9e307), ("mid", -1.2e308), ("mid", 6e307)])])
    c.add_rows("Gauge", [{"id": 1, "x": 1.0}, {"id": 2, "x": float("nan")}])
    return c


def field(name, source=None):
    return {"field": name, **({"source": source} if source else {})}


def ids(rows):
    return sorted(r["id"] for r in rows)


def sale(where=None, dialect="J", **more):
    return {"from": {"name": "Sale", "as": "s"}, **({"where": where} if where else {}), **more}, dialect


@pytest.mark.parametrize(
    ("dialect", "where", "expected"),
    [
        ("J", {"op": "!=", "left": field("g"), "right": {"value": None}}, [1, 3]),
        ("R", {"op": "!=", "left": field("g"), "right": {"value": None}}, []),
        ("J", {"op": "!=", "left": field("g"), "right": {"value": "a"}}, [2, 3, 4]),
        ("R", {"op": "!=", "left": field("g"), "right": {"value": "a"}}, [3]),
        ("J", {"op": "==", "left": field("g"), "right": {"value": None}}, []),
        ("J", {"op": "==", "left": field("id"), "right": {"value": "1"}}, []),
        ("J", {"op": "!=", "left": field("id"), "right": {"value": "1"}}, [1, 2, 3, 4]),
        ("J", {"op": "<", "left": field("id"), "right": {"value": "a"}}, [1, 2, 3, 4]),
        ("J", {"op": ">", "left": field("g"), "right": {"value": 5}}, [1, 3]),
        ("J", {"op": "In", "left": field("g"), "right": {"values": []}}, []),
        ("J", {"op": "NotIn", "left": field("g"), "right": {"values": []}}, [1, 2, 3, 4]),
        ("J", {"op": "NotIn", "left": field("g"), "right": {"values": ["a"]}}, [3]),
        ("J", {"op": "NotIn", "left": field("g"), "right": {"values": ["a", None]}}, []),
        ("J", {"op": "In", "left": field("id"), "right": {"values": ["1", 3, None]}}, [3]),
        ("J", {"or": [{"isNull": field("g")}, {"isNotNull": {"binary": {"op": "/", "left": field("n"), "right": field("d")}}}]}, [2, 3, 4]),
        ("R", {"op": "==", "left": {"binary": {"op": "/", "left": field("n"), "right": field("d")}}, "right": {"binary": {"op": "/", "left": {"value": 1}, "right": {"value": 0}}}}, [1]),
    ],
)
def test_conditions(tables, dialect, where, expected):
    body, _ = sale(where, columns=[field("id")])
    assert ids(run(tables, body, dialect=dialect)) == expected


def test_mixed_values_order_by_class(tables):
    rows = run(tables, {"from": {"name": "Reading"}, "orderBy": [field("value")], "columns": [field("id"), field("value")]})
    assert [(r["id"], r["value"]) for r in rows] == [(4, None), (3, False), (6, -2.0), (1, 3.5), (5, "high"), (2, "low")]


def test_average_ignores_what_is_no_number(tables):
    assert run(tables, {"from": {"name": "Reading"}, "columns": [{"aggregate": {"function": "avg", "args": [field("value")]}, "as": "m"}]}) == [{"m": 0.75}]


def harbour(inner):
    """Ports, left-joined with the bracket of ships and their crew."""
    crew = {"type": inner, "from": {"name": "Crew", "as": "c"}, "on": [{"left": field("aboard", "c"), "op": "==", "right": field("ship", "s")}]}
    ships = {"type": "left", "from": {"name": "Ship", "as": "s", "joins": [crew]}, "on": [{"left": field("port", "p"), "op": "==", "right": field("berth", "s")}]}
    return {"from": {"name": "Port", "as": "p", "joins": [ships]}, "orderBy": [field("port", "p"), field("ship", "s")], "columns": [field("port", "p"), field("ship", "s"), field("crew", "c")]}


def test_a_bracket_is_joined_first_and_extended_whole(tables):
    found = lambda inner: [tuple(r.values()) for r in run(tables, harbour(inner))]
    assert found("inner") == [(1, None, None), (2, None, None), (3, 102, 7)]
    assert found("left") == [(1, None, None), (2, 100, None), (2, 101, None), (3, 102, 7)]


def on(a, b):
    return [{"left": field(*a), "op": "==", "right": field(*b)}]


def test_left_joins_may_reach_out_of_their_bracket(tables):
    """Ports, left-joined with (ships left-joined with the watch of the port)."""
    watch = {"type": "left", "from": {"name": "Watch", "as": "w"}, "on": on(("at", "w"), ("port", "p"))}
    body = lambda kind: {"from": {"name": "Port", "as": "p", "joins": [{"type": kind, "from": {"name": "Ship", "as": "s", "joins": [watch]}, "on": on(("port", "p"), ("berth", "s"))}]}, "columns": [field("port", "p"), field("ship", "s"), field("watch", "w")]}
    found = lambda b: sorted((tuple(r.values()) for r in run(tables, b)), key=str)
    # port 1 has a watch but no ship: the bracket is extended whole
    assert found(body("left")) == [(1, None, None), (2, 100, 21), (2, 101, 21), (3, 102, None)]
    assert found(body("inner")) == [(2, 100, 21), (2, 101, 21), (3, 102, None)]
    # a second level: crew hangs on the deferred watch
    deep = body("left")
    deep["from"]["joins"][0]["from"]["joins"] = [watch | {"from": watch["from"] | {"joins": [{"type": "left", "from": {"name": "Crew", "as": "c"}, "on": on(("aboard", "c"), ("ship", "s"))}]}}]
    deep["columns"].append(field("crew", "c"))
    assert found(deep) == [(1, None, None, None), (2, 100, 21, None), (2, 101, 21, None), (3, 102, None, None)]


@pytest.mark.parametrize(("kind", "expected"), [("inner", [(2, 101), (3, 102)]), ("left", [(1, None), (2, 101), (3, 102)])])
def test_derived_tables_see_the_relations_before_them(tables, kind, expected):
    last = {"as": "d", "from": {"name": "Ship", "as": "s"}, "where": {"op": "==", "left": field("berth", "s"), "right": field("port", "p")}, "orderBy": [field("ship", "s") | {"desc": True}], "limit": 1, "columns": [field("ship", "s"), field("berth", "s")]}
    body = {"from": {"name": "Port", "as": "p", "joins": [{"type": kind, "from": {"query": last}, "on": on(("berth", "d"), ("port", "p"))}]}, "columns": [field("port", "p"), field("ship", "d")]}
    assert sorted((tuple(r.values()) for r in run(tables, body, dialect="R")), key=str) == expected


def test_correlation_by_an_equality_and_more(tables):
    """Loads of a bin that are smaller than it: rows meet by the equality, not each with every size there is."""
    c = Catalog(tables.spark)
    c.add_rows("Bin", [{"bin": b, "size": s} for b, s in ((1, 10), (1, 10), (2, None), (3, 5), (None, 9))])
    c.add_rows("Load", [{"at": b, "q": q} for b, q in ((1, 3), (1, 10), (1, 4), (3, 7), (3, 1), (2, 1), (None, 2))])
    smaller = {"from": {"name": "Load", "as": "l"}, "where": {"and": [{"op": "==", "left": field("at", "l"), "right": field("bin", "b")}, {"op": "<", "left": field("q", "l"), "right": field("size", "b")}]}}
    total = {"aggregate": {"function": "sum", "args": [field("q", "l")]}}
    derived = lambda kind: {"from": {"name": "Bin", "as": "b", "joins": [{"type": kind, "from": {"query": smaller | {"as": "d", "groupBy": [field("at", "l")], "columns": [field("at", "l"), total | {"as": "held"}]}}, "on": on(("at", "d"), ("bin", "b"))}]}, "columns": [field("bin", "b"), field("held", "d")]}
    scalar = lambda **more: {"from": {"name": "Bin", "as": "b"}, "columns": [field("bin", "b"), {"query": smaller | {"as": "x"} | more}]}
    for body, expected in (
        (derived("inner"), [(1, 7), (1, 7), (3, 1)]),
        (derived("left"), [(1, 7), (1, 7), (2, None), (3, 1), (None, None)]),
        (scalar(columns=[{"aggregate": {"function": "count", "args": [{"star": True}]}, "as": "n"}]), [(1, 2), (1, 2), (2, 0), (3, 1), (None, 0)]),
        (scalar(columns=[{"binary": {"op": "+", "left": total, "right": field("size", "b")}, "as": "more"}]), [(1, 17), (1, 17), (2, None), (3, 6), (None, None)]),
        (scalar(columns=[field("q", "l")], orderBy=[field("q", "l") | {"desc": True}], limit=1), [(1, 4), (1, 4), (2, None), (3, 1), (None, None)]),
    ):
        assert sorted((tuple(r.values()) for r in run(c, body, dialect="R")), key=str) == expected
        plan = to_frame(c, body, dialect="R")._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_nan_is_no_join_key(tables):
    body = {"from": {"name": "Gauge", "as": "a", "joins": [{"from": {"name": "Gauge", "as": "b"}, "on": [{"left": field("x", "a"), "op": "==", "right": field("x", "b")}]}]}, "columns": [field("id", "a")]}
    with pytest.raises(QueryError) as e:
        run(tables, body)
    assert e.value.code == "join_key_type"
    assert ids(run(tables, body, dialect="R")) == [1]


@pytest.mark.parametrize(("kind", "expected"), [("inner", [(2, 100), (2, 101), (3, 102)]), ("left", [(1, None), (2, 100), (2, 101), (3, 102)])])
def test_a_nested_loop_makes_no_product_of_the_tables(spark, tmp_path, kind, expected):
    spark.createDataFrame([(1,), (2,), (3,)], "port long").write.parquet(str(tmp_path / "Port.parquet"))
    spark.createDataFrame([(100, 2), (101, 2), (102, 3)], "ship long, berth long").write.parquet(str(tmp_path / "Ship.parquet"))
    c = Catalog(spark).add_parquet(str(tmp_path), ["Port", "Ship"])
    body = {"from": {"name": "Port", "as": "p", "joins": [{"type": kind, "from": {"name": "Ship", "as": "s"}, "hints": {"algorithms": ["nestedLoop"]}, "on": on(("port", "p"), ("berth", "s"))}]}, "columns": [field("port", "p"), field("ship", "s")]}
    assert sorted((tuple(r.values()) for r in run(c, body)), key=str) == expected
    plan = to_frame(c, body)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("parts", [1, 3])
def test_ties_keep_the_order_of_the_file(spark, tmp_path, parts):
    """LIMIT over tied keys takes the rows that stand first, however the scan is split; filters reach the scan."""
    spark.createDataFrame([(n, n % 2, float(n)) for n in range(40)], "n int, k int, v double").coalesce(1).write.parquet(str(tmp_path / "t.parquet"))
    c = Catalog(spark).add_parquet(str(tmp_path), ["t"])
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 27 if parts == 1 else 300))
    body = {"from": {"name": "t"}, "where": {"op": ">", "left": field("v"), "right": {"value": 9.0}}, "orderBy": [field("k")], "limit": 5, "columns": [field("n")]}
    assert [r["n"] for r in run(c, body)] == [10, 12, 14, 16, 18]
    first = {"from": {"name": "t"}, "where": body["where"], "groupBy": [field("k")], "columns": [field("k"), {"aggregate": {"function": "first", "args": [field("n")]}, "as": "f"}], "orderBy": [field("k")]}
    assert run(c, first) == [{"k": 0, "f": 10}, {"k": 1, "f": 11}]
    plan = to_frame(c, first)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(v,9.0)" in plan
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_groups_that_cannot_tie_carry_no_places(spark, tmp_path):
    """ORDER BY over every group key leaves no ties, so the places of rows stay out of joins and groups; a part of them does not."""
    spark.createDataFrame([(n, n % 3, n % 2) for n in range(12)], "n int, k int, h int").coalesce(1).write.parquet(str(tmp_path / "t.parquet"))
    c = Catalog(spark).add_parquet(str(tmp_path), ["t"])
    total = {"aggregate": {"function": "count", "args": [{"star": True}]}, "as": "c"}
    body = lambda *keys: {"from": {"name": "t", "as": "t", "joins": [{"from": {"name": "t", "as": "u"}, "on": on(("n", "t"), ("n", "u"))}]}, "groupBy": [field("k", "t"), field("h", "t")], "columns": [field("k", "t"), field("h", "t"), total], "orderBy": [{"field": "c"}, *keys], "limit": 3}
    plan = lambda b: to_frame(c, b)._jdf.queryExecution().executedPlan().toString()
    all_keys = body(field("h", "t") | {"desc": True}, field("k", "t"))
    assert [tuple(r.values()) for r in run(c, all_keys)] == [(0, 1, 2), (1, 1, 2), (2, 1, 2)]
    assert "row_index" not in plan(all_keys) and "SortAggregate" not in plan(all_keys)
    some = body(field("h", "t") | {"desc": True})
    assert [tuple(r.values()) for r in run(c, some)] == [(1, 1, 2), (0, 1, 2), (2, 1, 2)]
    assert "row_index" in plan(some)


def test_groups(tables):
    n = {"aggregate": {"function": "count", "args": [{"star": True}]}}
    rows = run(tables, {"from": {"name": "Sale"}, "groupBy": [field("g")], "columns": [field("g"), n, {"aggregate": {"function": "sum", "args": [field("n")]}, "as": "s"}], "orderBy": [field("g")]})
    assert rows == [{"g": None, "COUNT(*)": 2, "s": 4.0}, {"g": "a", "COUNT(*)": 1, "s": 2.0}, {"g": "b", "COUNT(*)": 1, "s": 5.0}]
    having = {"op": "==", "left": {"value": None}, "right": {"value": None}}
    body = {"from": {"name": "Sale"}, "groupBy": [field("g")], "having": having}
    assert len(run(tables, body)) == 3
    assert run(tables, body, dialect="R") == []


def test_first_and_last_by_dialect(tables):
    columns = [{"aggregate": {"function": f, "args": [field("n")]}, "as": f} for f in ("first", "last")]
    body = {"from": {"name": "Sale"}, "where": {"isNull": field("g")}, "columns": columns}
    assert run(tables, body) == [{"first": None, "last": 4.0}]
    assert run(tables, body, dialect="R") == [{"first": 4.0, "last": 4.0}]


def test_recursive_groups_take_first_values(tables):
    body = {"from": {"name": "Sale", "as": "s"}, "groupBy": [field("g")], "columns": [field("id"), {"aggregate": {"function": "count", "args": [{"star": True}]}}], "orderBy": [field("id")]}
    assert run(tables, body, dialect="R") == [{"id": 1, "count": 1}, {"id": 2, "count": 2}, {"id": 3, "count": 1}]


def test_overflow_is_an_error(tables):
    total = {"aggregate": {"function": "sum", "args": [field("x")]}, "as": "t"}
    with pytest.raises(QueryError, match="overflow"):
        run(tables, {"from": {"name": "Huge"}, "groupBy": [field("g")], "columns": [field("g"), total]})
    assert run(tables, {"from": {"name": "Huge"}, "where": {"op": "==", "left": field("g"), "right": {"value": "mid"}}, "columns": [total]}) == [{"t": 0.0}]
    with pytest.raises(QueryError, match="overflow"):
        run(tables, {"from": {"name": "Huge"}, "columns": [{"binary": {"op": "*", "left": field("x"), "right": {"value": 10}}, "as": "y"}]})


def test_empty_groups(tables):
    none = {"op": "<", "left": field("id"), "right": {"value": 0}}
    count = {"aggregate": {"function": "count", "args": [{"star": True}]}, "as": "n"}
    assert run(tables, {"from": {"name": "Sale"}, "where": none, "columns": [count]}) == [{"n": 0}]
    assert run(tables, {"from": {"name": "Sale"}, "where": none, "groupBy": [field("g")], "columns": [count]}) == []


@pytest.mark.parametrize(
    ("body", "code"),
    [
        ({"from": {"name": "Sale"}, "limits": 3}, "join_shape"),
        ({"from": {"name": "Sale", "joins": [{"type": "right", "from": {"name": "A"}, "on": [{}]}]}}, "join_type"),
        ({"from": {"name": "Sale", "joins": [{"from": {"name": "A"}, "on": [{"left": field("id"), "op": "<", "right": field("id")}]}]}}, "join_operator"),
        ({"from": {"name": "Sale", "joins": [{"from": {"name": "Sale"}, "on": [{"left": field("id"), "op": "==", "right": field("id")}]}]}}, "join_scope"),
        ({"from": {"name": "Sale"}, "columns": [{"aggregate": {"function": "sum", "args": [{"star": True}]}}]}, "join_aggregate"),
        ({"from": {"name": "Sale"}, "columns": [{"aggregate": {"function": "min", "args": [field("id")], "distinct": True}}]}, "join_aggregate"),
        ({"from": {"name": "Sale"}, "groupBy": [field("g")], "columns": [field("id")]}, "join_aggregate"),
        ({"from": {"name": "Sale"}, "columns": [field("nope")]}, "join_field"),
        ({"from": {"name": "Sale"}, "limit": 5000}, "join_shape"),
        ({"from": {"name": "Sale", "joins": [{"from": {"name": "A"}, "hints": {"algorithms": ["quick"]}, "on": [{"left": field("id", "Sale"), "op": "==", "right": field("id", "A")}]}]}}, "join_algorithm"),
        ({"from": {"name": "Sale"}, "columns": [{"query": {"from": {"name": "A"}}}]}, "join_shape"),
    ],
)
def test_refusals(tables, body, code):
    with pytest.raises(QueryError) as e:
        to_frame(tables, body, dialect="J")
    assert e.value.code == code


def test_yaml_round_trip_and_duplicate_keys(tables):
    q = parse("from: {name: Sale, as: s}\norderBy: [{field: id, desc: true}]\nlimit: 2\ncolumns: [{field: id}]\n")
    assert parse(q.to_yaml()) == q
    assert [r["id"] for r in run(tables, q)] == [4, 3]
    with pytest.raises(QueryError):
        parse("from: {name: Sale}\nfrom: {name: A}\n")


def test_limit_zero_and_offset(tables):
    body = {"from": {"name": "Sale"}, "orderBy": [field("id")], "limit": 0, "columns": [field("id")]}
    assert len(run(tables, body)) == 4
    with pytest.raises(QueryError):
        parse(body, dialect="R")
    assert ids(run(tables, {**body, "offset": 3})) == [4]


def test_scalar_cardinality_and_membership(tables):
    many = {"from": {"name": "A", "as": "a"}, "columns": [{"query": {"as": "x", "from": {"name": "Sale", "as": "s"}, "columns": [field("id", "s")]}}]}
    with pytest.raises(QueryError) as e:
        run(tables, many)
    assert e.value.code == "cardinality"
    notin = lambda name: {"from": {"name": "A", "as": "a"}, "where": {"or": [{"op": "NotIn", "left": field("id", "a"), "right": {"query": {"as": "x", "from": {"name": "Sale", "as": "s"}, "columns": [field(name, "s")]}}}]}, "columns": [field("id", "a")]}
    assert run(tables, notin("n")) == []
    assert ids(run(tables, notin("d"))) == []
    with pytest.raises(QueryError):
        run(tables, {"from": {"name": "A", "as": "a"}, "where": {"isNull": {"query": {"as": "x", "from": {"name": "Sale"}, "columns": [field("id"), field("g")]}}}, "columns": [field("id", "a")]})


def test_pages_and_bounds(tables):
    df = to_frame(tables, {"from": {"name": "Sale"}, "columns": [field("id")]})
    assert sorted(r["id"] for p in pages(df, 3) for r in p) == [1, 2, 3, 4]
    with pytest.raises(QueryError):
        bounded(df, 3)
    assert bounded(df, 4).count() == 4


def test_rights_need_composition(tables, spark):
    from lodeframe.governance import canonical_json, composed_frame, digest, read_plan, validate_read_plan

    c = Catalog(spark).add_rows("S", [{"id": 1}], rights={"license": "open"})
    q = parse({"from": {"name": "S"}, "columns": [field("id")]})
    with pytest.raises(UnsupportedError):
        run(c, q)
    out = composed_frame(c, q, lambda leaf, rights: {"ok": rights["license"]})
    assert out.frame.count() == 1 and out.envelope["inputs"][0]["admission"] == {"ok": "open"}
    plan = read_plan([{"provider": "p", "resource": "r"}])
    validate_read_plan(plan)
    with pytest.raises(QueryError):
        validate_read_plan({**plan, "digest": digest([1])})
    assert canonical_json({"b": 1.0, "a": [1e21, 0.000001, 1e-7, -0.0, True, None]}) == '{"a":[1e+21,0.000001,1e-7,0,true,null],"b":1}'
    assert math.isfinite(len(digest({})))


def test_fields_from_two_levels_out(tables):
    """With and without an equality that hands the field on."""
    inner = lambda op: {"from": {"name": "Sale", "as": "t"}, "where": {"op": op, "left": field("id", "t"), "right": field("id", "s")}}
    body = lambda link, op: {"from": {"name": "Sale", "as": "s"}, "where": {"exists": {"query": {"from": {"name": "A", "as": "a"}, "where": {"and": [*link, {"exists": {"query": inner(op)}}]}}}}, "columns": [field("id", "s")]}
    equal = [{"op": "==", "left": field("id", "a"), "right": field("id", "s")}]
    assert ids(run(tables, body(equal, "=="))) == [1, 2]
    assert ids(run(tables, body(equal, ">"))) == [1, 2]
    assert ids(run(tables, body([], ">"))) == [1, 2, 3]
    assert ids(run(tables, body([{"op": "<", "left": field("id", "a"), "right": field("id", "s")}], "<"))) == [2, 3, 4]


def test_strict_overflow_progress_and_tags(tables, spark):
    hidden = {"from": {"name": "Huge"}, "groupBy": [field("g")], "columns": [field("g")], "having": {"op": "==", "left": field("g"), "right": {"value": "mid"}}, "orderBy": [{"aggregate": {"function": "sum", "args": [field("x")]}}]}
    with pytest.raises(QueryError, match="overflow"):
        check_overflow(tables, hidden)
    check_overflow(tables, {**hidden, "where": {"op": "==", "left": field("g"), "right": {"value": "mid"}}})
    df, seen = observed(to_frame(tables, {"from": {"name": "Sale"}, "columns": [field("id")]}))
    with cancellable(spark, "t") as cancel:
        assert df.count() == 4 and callable(cancel)
    assert seen.get["rows"] == 4
