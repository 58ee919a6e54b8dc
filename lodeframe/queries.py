"""The registered queries of the engine, each with the SQL it is held against on the same tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from lodeframe.plans.run import to_frame
from lodeframe.sources.catalog import Catalog

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    return Catalog(spark).add_parquet(sf_dir, TABLES)


def document(name: str, body: str | Mapping[str, Any], sql: str, *, dialect: str = "J") -> None:
    """Register a query document."""
    _QUERIES[name] = lambda spark, sf_dir: to_frame(catalog(spark, sf_dir), body, dialect=dialect)
    _SQL[name] = sql


def register(name: str, sql: str | None = None):
    """Register a function of (spark, sf_dir)."""

    def take(f: Callable[[SparkSession, str], DataFrame]):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return take


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# --- flat documents (J) -------------------------------------------------------------------------------------

FLAGSHIP = """
from:
  {name: lineitem, as: l, joins: [
    {from: {name: orders, as: o, joins: [
      {from: {name: customer, as: c, joins: [
        {from: {name: nation, as: n}, on: [{left: {field: c_nationkey, source: c}, op: ==, right: {field: n_nationkey, source: n}}]}]},
       on: [{left: {field: o_custkey, source: o}, op: ==, right: {field: c_custkey, source: c}}]}]},
     on: [{left: {field: l_orderkey, source: l}, op: ==, right: {field: o_orderkey, source: o}}]}]}
groupBy: [{field: n_name, source: n}]
columns:
  - {field: n_name, source: n}
  - {aggregate: {function: count, args: [{star: true}]}, as: lines}
  - {aggregate: {function: sum, args: [{field: l_quantity, source: l}]}, as: quantity}
having: {op: ">", left: {field: quantity}, right: {value: 100}}
orderBy: [{field: quantity, desc: true}, {field: n_name, source: n}]
limit: 20
"""

document("join_chain_4way", FLAGSHIP, """
SELECT n_name, count(*) AS lines, sum(l_quantity) AS quantity
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
GROUP BY n_name HAVING sum(l_quantity) > 100 ORDER BY quantity DESC, n_name LIMIT 20""")

_LINE = "columns: [{field: l_orderkey}, {field: l_partkey}, {field: l_suppkey}, {field: l_linenumber}, {field: l_quantity}]"

document("scan_filter_cmp", f"""
from: {{name: lineitem, as: l}}
where: {{and: [{{op: ">=", left: {{field: l_quantity}}, right: {{value: 30}}}}, {{op: "<", left: {{field: l_discount}}, right: {{value: 0.05}}}}, {{or: [{{op: ==, left: {{field: l_returnflag}}, right: {{value: R}}}}, {{op: "!=", left: {{field: l_linestatus}}, right: {{value: O}}}}]}}]}}
{_LINE}
""", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 30 AND l_discount < 0.05 AND (l_returnflag = 'R' OR l_linestatus <> 'O')")

document("filter_in", """
from: {name: orders}
where: {op: In, left: {field: o_orderpriority}, right: {values: [1-URGENT, 2-HIGH]}}
columns: [{field: o_orderkey}, {field: o_orderpriority}]
""", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")

document("filter_not_in", """
from: {name: part}
where: {and: [{op: NotIn, left: {field: p_size}, right: {values: [1, 2, 3, 4]}}, {op: NotIn, left: {field: p_brand}, right: {values: []}}]}
columns: [{field: p_partkey}, {field: p_size}]
""", "SELECT p_partkey, p_size FROM part WHERE p_size NOT IN (1, 2, 3, 4)")

document("filter_not_in_null_item", """
from: {name: part}
where: {or: [{op: NotIn, left: {field: p_size}, right: {values: [1, null]}}, {op: In, left: {field: p_size}, right: {values: [7, null]}}]}
columns: [{field: p_partkey}, {field: p_size}]
""", "SELECT p_partkey, p_size FROM part WHERE p_size NOT IN (1, NULL) OR p_size IN (7, NULL)")

_LABELLED = """
from: {name: documents, as: d, joins: [{type: left, from: {name: labels, as: l}, on: [{left: {field: doc_id, source: d}, op: ==, right: {field: doc_id, source: l}}]}]}
"""

document("filter_null_tests", _LABELLED + """
where: {or: [{isNull: {field: quality}}, {and: [{isNotNull: {field: toxic}}, {op: ==, left: {field: toxic}, right: {value: 1}}]}]}
columns: [{field: doc_id, source: d}, {field: quality}, {field: toxic}]
""", "SELECT d.doc_id, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE quality IS NULL OR (toxic IS NOT NULL AND toxic = 1)")

document("filter_ne_two_valued", _LABELLED + """
where: {and: [{op: "!=", left: {field: quality}, right: {value: 1}}, {op: "!=", left: {field: lang, source: d}, right: {value: null}}]}
columns: [{field: doc_id, source: d}, {field: quality}]
""", "SELECT d.doc_id, quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE quality IS DISTINCT FROM 1 AND d.lang IS NOT NULL")

document("filter_classes", _LABELLED + """
where: {or: [{op: ==, left: {field: quality}, right: {value: "1"}}, {op: "<", left: {field: quality}, right: {value: a}}]}
columns: [{field: doc_id, source: d}, {field: quality}]
""", "SELECT d.doc_id, quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE quality IS NOT NULL")

document("filter_arith", """
from: {name: lineitem}
where: {op: ">", left: {binary: {op: "*", left: {field: l_quantity}, right: {binary: {op: "-", left: {value: 1}, right: {field: l_discount}}}}}, right: {binary: {op: +, left: {field: l_linenumber}, right: {value: 40}}}}
""" + _LINE, "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity * (1 - l_discount) > l_linenumber + 40")

document("project_arith_div_zero", """
from: {name: lineitem}
columns:
  - {field: l_orderkey}
  - {field: l_partkey}
  - {binary: {op: /, left: {field: l_quantity}, right: {field: l_discount}}, as: ratio}
  - {binary: {op: "*", left: {field: l_returnflag}, right: {value: 2}}, as: nothing}
  - {value: line, as: kind}
""", "SELECT l_orderkey, l_partkey, CASE WHEN l_discount = 0 THEN NULL ELSE l_quantity / l_discount END AS ratio, CAST(NULL AS DOUBLE) AS nothing, 'line' AS kind FROM lineitem")

document("wildcard_exclude", """
from: {name: customer, as: c, joins: [{from: {name: nation, as: n}, on: [{left: {field: c_nationkey, source: c}, op: ==, right: {field: n_nationkey, source: n}}]}]}
columns: [{wildcard: {source: c, exclude: [c_acctbal, c_nationkey]}}, {wildcard: {source: n, exclude: [n_regionkey]}}]
""", "SELECT c_custkey, c_name, c_mktsegment, n_nationkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")

document("implicit_columns_left", _LABELLED, """
SELECT d.doc_id, text, lang, source, n_chars, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")

document("bounded_scan_join", """
from: {name: orders, as: o, scan: {orderBy: [{field: o_orderkey, desc: true}], limit: 100}, joins: [{from: {name: customer, as: c}, on: [{left: {field: o_custkey, source: o}, op: ==, right: {field: c_custkey, source: c}}]}]}
columns: [{field: o_orderkey, source: o}, {field: c_name, source: c}]
""", "SELECT o_orderkey, c_name FROM (SELECT * FROM orders ORDER BY o_orderkey DESC LIMIT 100) JOIN customer ON o_custkey = c_custkey")

document("join_inner_2way", """
from: {name: customer, as: c, joins: [{from: {name: nation, as: n}, on: [{left: {field: c_nationkey, source: c}, op: ==, right: {field: n_nationkey, source: n}}]}]}
where: {op: ==, left: {field: n_name}, right: {value: NATION_2}}
columns: [{field: c_custkey}, {field: c_name}, {field: n_name}]
""", "SELECT c_custkey, c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_2'")

document("join_chain_6way", """
from: {name: lineitem, as: l, joins: [
  {from: {name: orders, as: o}, on: [{left: {field: l_orderkey, source: l}, op: ==, right: {field: o_orderkey, source: o}}]},
  {from: {name: customer, as: c}, on: [{left: {field: o_custkey, source: o}, op: ==, right: {field: c_custkey, source: c}}]},
  {from: {name: nation, as: n}, on: [{left: {field: c_nationkey, source: c}, op: ==, right: {field: n_nationkey, source: n}}]},
  {from: {name: region, as: r}, on: [{left: {field: n_regionkey, source: n}, op: ==, right: {field: r_regionkey, source: r}}]},
  {from: {name: part, as: p}, on: [{left: {field: l_partkey, source: l}, op: ==, right: {field: p_partkey, source: p}}]}]}
groupBy: [{field: r_name}, {field: p_brand}]
columns: [{field: r_name}, {field: p_brand}, {aggregate: {function: count, args: [{star: true}]}, as: n}, {aggregate: {function: max, args: [{field: l_quantity}]}, as: most}]
""", """SELECT r_name, p_brand, count(*) AS n, max(l_quantity) AS most FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey GROUP BY r_name, p_brand""")

document("join_left_bracketed", """
from: {name: customer, as: c, joins: [{type: left, from: {name: orders, as: o, joins: [{from: {name: lineitem, as: l}, on: [{left: {field: o_orderkey, source: o}, op: ==, right: {field: l_orderkey, source: l}}]}]}, on: [{left: {field: c_custkey, source: c}, op: ==, right: {field: o_custkey, source: o}}]}]}
groupBy: [{field: c_custkey, source: c}]
columns: [{field: c_custkey, source: c}, {aggregate: {function: count, args: [{field: l_linenumber, source: l}]}, as: n_lines}]
""", "SELECT c_custkey, count(l_linenumber) AS n_lines FROM customer LEFT JOIN (orders JOIN lineitem ON o_orderkey = l_orderkey) ON c_custkey = o_custkey GROUP BY c_custkey")

document("join_left_anti", """
from: {name: orders, as: o, joins: [{type: left, from: {name: lineitem, as: l}, on: [{left: {field: o_orderkey, source: o}, op: ==, right: {field: l_orderkey, source: l}}]}]}
where: {isNull: {field: l_orderkey, source: l}}
columns: [{field: o_orderkey, source: o}]
""", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")

document("join_self", """
from: {name: nation, as: a, joins: [{from: {name: nation, as: b}, on: [{left: {field: n_regionkey, source: a}, op: ==, right: {field: n_regionkey, source: b}}]}]}
where: {op: "<", left: {field: n_nationkey, source: a}, right: {field: n_nationkey, source: b}}
columns: [{field: n_name, source: a, as: one}, {field: n_name, source: b, as: other}]
""".replace(", as: one}", "}").replace("{field: n_name, source: a}", "{field: n_name, source: a, as: one}"), "SELECT a.n_name AS one, b.n_name AS other FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey < b.n_nationkey")

document("join_multi_predicate", """
from: {name: customer, as: c, joins: [{from: {name: supplier, as: s}, on: [{left: {field: c_nationkey, source: c}, op: ==, right: {field: s_nationkey, source: s}}, {left: {field: c_custkey, source: c}, op: ==, right: {field: s_suppkey, source: s}}]}]}
columns: [{field: c_custkey}, {field: s_name}]
""", "SELECT c_custkey, s_name FROM customer JOIN supplier ON c_nationkey = s_nationkey AND c_custkey = s_suppkey")

document("join_same_side", """
from: {name: region, as: r, joins: [{type: left, from: {name: nation, as: n}, on: [{left: {field: r_regionkey, source: r}, op: ==, right: {field: n_regionkey, source: n}}, {left: {field: n_nationkey, source: n}, op: ==, right: {field: n_regionkey, source: n}}]}]}
columns: [{field: r_name}, {field: n_name}]
""", "SELECT r_name, n_name FROM region LEFT JOIN nation ON r_regionkey = n_regionkey AND n_nationkey = n_regionkey")

document("join_key_classes", """
from: {name: nation, as: n, joins: [{type: left, from: {name: region, as: r}, on: [{left: {field: n_regionkey, source: n}, op: ==, right: {field: r_name, source: r}}]}]}
columns: [{field: n_name}, {field: r_name}]
""", "SELECT n_name, CAST(NULL AS VARCHAR) AS r_name FROM nation")

document("join_correlated_right", """
from: {name: region, as: r, joins: [{type: left, from: {name: nation, as: n, joins: [{from: {name: supplier, as: s}, on: [{left: {field: s_nationkey, source: s}, op: ==, right: {field: n_nationkey, source: n}}, {left: {field: s_suppkey, source: s}, op: ==, right: {field: r_regionkey, source: r}}]}]}, on: [{left: {field: n_regionkey, source: n}, op: ==, right: {field: r_regionkey, source: r}}]}]}
columns: [{field: r_name}, {field: n_name}, {field: s_name}]
""", "SELECT r_name, n_name, s_name FROM region r LEFT JOIN (nation n JOIN supplier s ON s_nationkey = n_nationkey) ON n_regionkey = r_regionkey AND s_suppkey = r_regionkey")

for _hint in ("hash", "merge", "lookup", "nestedLoop"):
    document(f"join_hint_{_hint.lower()}", f"""
from: {{name: orders, as: o, joins: [{{from: {{name: customer, as: c}}, hints: {{algorithms: [{_hint}]}}, on: [{{left: {{field: o_custkey, source: o}}, op: ==, right: {{field: c_custkey, source: c}}}}]}}]}}
groupBy: [{{field: c_mktsegment}}]
columns: [{{field: c_mktsegment}}, {{aggregate: {{function: count, args: [{{star: true}}]}}, as: n}}]
""", "SELECT c_mktsegment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment")

document("agg_group", """
from: {name: lineitem}
groupBy: [{field: l_returnflag}, {field: l_linestatus}]
columns:
  - {field: l_returnflag}
  - {field: l_linestatus}
  - {aggregate: {function: sum, args: [{field: l_quantity}]}, as: sum_qty}
  - {aggregate: {function: avg, args: [{field: l_linenumber}]}, as: avg_line}
  - {aggregate: {function: min, args: [{field: l_shipdate}]}, as: first_ship}
  - {aggregate: {function: max, args: [{field: l_extendedprice}]}, as: most}
  - {aggregate: {function: count, args: [{star: true}]}, as: n}
""", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, avg(l_linenumber) AS avg_line, min(l_shipdate) AS first_ship, max(l_extendedprice) AS most, count(*) AS n FROM lineitem GROUP BY ALL")

document("agg_global_empty", """
from: {name: lineitem}
where: {op: "<", left: {field: l_quantity}, right: {value: 0}}
columns: [{aggregate: {function: count, args: [{star: true}]}, as: n}, {aggregate: {function: sum, args: [{field: l_quantity}]}, as: s}, {aggregate: {function: max, args: [{field: l_returnflag}]}, as: m}]
""", "SELECT count(*) AS n, sum(l_quantity) AS s, max(l_returnflag) AS m FROM lineitem WHERE l_quantity < 0")

document("agg_count_distinct", """
from: {name: orders}
groupBy: [{field: o_orderstatus}]
columns: [{field: o_orderstatus}, {aggregate: {function: count, args: [{field: o_custkey}], distinct: true}, as: customers}, {aggregate: {function: count, args: [{field: o_custkey}]}, as: n}]
""", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers, count(o_custkey) AS n FROM orders GROUP BY o_orderstatus")

document("agg_sum_distinct", """
from: {name: lineitem}
groupBy: [{field: l_returnflag}]
columns: [{field: l_returnflag}, {aggregate: {function: sum, args: [{field: l_quantity}], distinct: true}, as: s}, {aggregate: {function: avg, args: [{field: l_linenumber}], distinct: true}, as: a}]
""", "SELECT l_returnflag, sum(DISTINCT l_quantity) AS s, avg(DISTINCT l_linenumber) AS a FROM lineitem GROUP BY l_returnflag")

document("agg_first_last", """
from: {name: orders}
groupBy: [{field: o_orderstatus}]
columns: [{field: o_orderstatus}, {aggregate: {function: first, args: [{field: o_custkey}]}, as: first_customer}, {aggregate: {function: last, args: [{field: o_custkey}]}, as: last_customer}, {aggregate: {function: last, args: [{field: o_orderkey}]}, as: last_key}]
""", "SELECT o_orderstatus, first(o_custkey ORDER BY o_orderkey) AS first_customer, last(o_custkey ORDER BY o_orderkey) AS last_customer, last(o_orderkey ORDER BY o_orderkey) AS last_key FROM orders GROUP BY o_orderstatus")

document("agg_arith", """
from: {name: lineitem}
groupBy: [{field: l_returnflag}]
columns:
  - {field: l_returnflag}
  - {aggregate: {function: max, args: [{binary: {op: "*", left: {field: l_quantity}, right: {field: l_linenumber}}}]}, as: most}
  - {binary: {op: /, left: {aggregate: {function: sum, args: [{field: l_quantity}]}}, right: {aggregate: {function: count, args: [{star: true}]}}}, as: mean}
""", "SELECT l_returnflag, max(l_quantity * l_linenumber) AS most, sum(l_quantity) / count(*) AS mean FROM lineitem GROUP BY l_returnflag")

document("agg_having_expr", """
from: {name: orders}
groupBy: [{field: o_custkey}]
columns: [{field: o_custkey}, {aggregate: {function: count, args: [{star: true}]}, as: n}]
having: {or: [{op: ">", left: {binary: {op: "*", left: {field: n}, right: {value: 2}}}, right: {value: 30}}, {op: ==, left: {field: o_custkey}, right: {value: 7}}]}
""", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) * 2 > 30 OR o_custkey = 7")

document("agg_having_null_eq", _LABELLED + """
groupBy: [{field: quality}, {field: lang}]
columns: [{field: quality}, {field: lang}, {aggregate: {function: count, args: [{star: true}]}, as: n}]
having: {or: [{op: ==, left: {field: quality}, right: {value: null}}, {op: "<", left: {field: quality}, right: {value: 1}}]}
""", "SELECT quality, lang, count(*) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY quality, lang HAVING quality IS NULL OR coalesce(quality < 1, false)")

document("agg_group_keys_only", """
from: {name: part}
groupBy: [{field: p_brand}, {field: p_size}]
""", "SELECT DISTINCT p_brand, p_size FROM part")

document("agg_unaliased_names", """
from: {name: orders, as: o}
columns: [{aggregate: {function: count, args: [{star: true}]}}, {aggregate: {function: max, args: [{field: o_orderkey, source: o}]}}]
""", 'SELECT count(*) AS "COUNT(*)", max(o_orderkey) AS "MAX(o.o_orderkey)" FROM orders o')

document("agg_alias_order", """
from: {name: orders}
groupBy: [{field: o_custkey}]
columns: [{field: o_custkey}, {aggregate: {function: count, args: [{star: true}]}, as: n}]
orderBy: [{field: n, desc: true}, {field: o_custkey}]
limit: 25
""", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 25")

document("order_expr_unprojected", """
from: {name: part}
orderBy: [{binary: {op: "-", left: {field: p_size}, right: {field: p_retailprice}}}, {field: p_partkey}]
columns: [{field: p_name}, {field: p_partkey}]
limit: 50
""", "SELECT p_name, p_partkey FROM part ORDER BY p_size - p_retailprice, p_partkey LIMIT 50")

document("order_nulls", _LABELLED + """
orderBy: [{field: quality, desc: true}, {field: toxic}, {field: doc_id, source: d}]
columns: [{field: doc_id, source: d}, {field: quality}, {field: toxic}]
""", "SELECT d.doc_id, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id ORDER BY quality DESC NULLS LAST, toxic ASC NULLS FIRST, d.doc_id")

document("order_ties", """
from: {name: orders}
orderBy: [{field: o_orderpriority}, {field: o_orderstatus, desc: true}]
limit: 200
columns: [{field: o_orderkey}, {field: o_orderpriority}]
""", "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderpriority, o_orderstatus DESC, o_orderkey LIMIT 200")

document("order_ties_groups", """
from: {name: orders}
groupBy: [{field: o_custkey}]
columns: [{field: o_custkey}, {aggregate: {function: count, args: [{star: true}]}, as: n}]
orderBy: [{field: n, desc: true}]
limit: 40
""", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, min(o_orderkey) LIMIT 40")

document("agg_first_last_filtered", """
from: {name: orders}
where: {op: ">", left: {field: o_totalprice}, right: {value: 100000}}
groupBy: [{field: o_orderpriority}]
columns: [{field: o_orderpriority}, {aggregate: {function: first, args: [{field: o_custkey}]}, as: first_customer}, {aggregate: {function: last, args: [{field: o_custkey}]}, as: last_customer}]
""", "SELECT o_orderpriority, first(o_custkey ORDER BY o_orderkey) AS first_customer, last(o_custkey ORDER BY o_orderkey) AS last_customer FROM orders WHERE o_totalprice > 100000 GROUP BY o_orderpriority")

document("order_offset_limit", """
from: {name: events}
orderBy: [{field: event_id, desc: true}]
offset: 40
limit: 60
columns: [{field: event_id}, {field: event_type}]
""", "SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 60 OFFSET 40")

# --- recursive documents (R) --------------------------------------------------------------------------------

document("sub_scalar_corr_count", """
from: {name: customer, as: c}
columns:
  - {field: c_custkey, source: c}
  - query: {as: n_orders, from: {name: orders, as: o}, where: {op: ==, left: {field: o_custkey, source: o}, right: {field: c_custkey, source: c}}, columns: [{aggregate: {function: count, args: [{star: true}]}, as: n}]}
""", "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_orders FROM customer", dialect="R")

document("sub_scalar_uncorr", """
from: {name: region, as: r}
columns: [{field: r_name, source: r}, {query: {as: most, from: {name: part, as: p}, columns: [{aggregate: {function: max, args: [{field: p_size, source: p}]}, as: m}]}}]
""", "SELECT r_name, (SELECT max(p_size) FROM part) AS most FROM region", dialect="R")

document("sub_in", """
from: {name: customer, as: c}
where: {op: In, left: {field: c_nationkey, source: c}, right: {query: {as: x, from: {name: nation, as: n}, where: {op: ==, left: {field: n_regionkey, source: n}, right: {value: 2}}, columns: [{field: n_nationkey, source: n}]}}}
columns: [{field: c_custkey, source: c}]
""", "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)", dialect="R")

document("sub_not_in_null", """
from: {name: documents, as: d}
where: {op: NotIn, left: {field: n_chars, source: d}, right: {query: {as: x, from: {name: documents, as: e, joins: [{type: left, from: {name: labels, as: l}, on: [{left: {field: doc_id, source: e}, op: ==, right: {field: doc_id, source: l}}]}]}, columns: [{field: quality, source: l}]}}}
columns: [{field: doc_id, source: d}]
""", "SELECT doc_id FROM documents WHERE n_chars NOT IN (SELECT quality FROM documents e LEFT JOIN labels l ON e.doc_id = l.doc_id)", dialect="R")

document("sub_not_in", """
from: {name: documents, as: d}
where: {op: NotIn, left: {field: doc_id, source: d}, right: {query: {as: x, from: {name: labels, as: l}, columns: [{field: doc_id, source: l}]}}}
columns: [{field: doc_id, source: d}]
""", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)", dialect="R")

document("sub_exists", """
from: {name: customer, as: c}
where: {exists: {query: {as: x, from: {name: events, as: e}, where: {op: ==, left: {field: user_id, source: e}, right: {field: c_custkey, source: c}}}}}
columns: [{field: c_custkey, source: c}]
""", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey)", dialect="R")

document("sub_not_exists", """
from: {name: customer, as: c}
where: {notExists: {query: {from: {name: events, as: e}, where: {op: ==, left: {field: user_id, source: e}, right: {field: c_custkey, source: c}}}}}
columns: [{field: c_custkey, source: c}]
""", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey)", dialect="R")

document("sub_derived_join", """
from: {name: customer, as: c, joins: [{type: left, from: {query: {as: s, from: {name: orders, as: o}, where: {op: ==, left: {field: o_orderstatus, source: o}, right: {value: F}}, groupBy: [{field: o_custkey, source: o}], columns: [{field: o_custkey, source: o}, {aggregate: {function: count, args: [{star: true}]}, as: n}]}}, on: [{left: {field: c_custkey, source: c}, op: ==, right: {field: o_custkey, source: s}}]}]}
columns: [{field: c_custkey, source: c}, {field: n, source: s}]
""", "SELECT c_custkey, n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey) ON c_custkey = o_custkey", dialect="R")

document("sub_multilevel", """
from: {name: customer, as: c}
where: {exists: {query: {from: {name: orders, as: o}, where: {and: [{op: ==, left: {field: o_custkey, source: o}, right: {field: c_custkey, source: c}}, {exists: {query: {from: {name: events, as: e}, where: {op: ==, left: {field: user_id, source: e}, right: {field: c_custkey, source: c}}}}}]}}}}
columns: [{field: c_custkey, source: c}]
""", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AND EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey)", dialect="R")

document("sub_corr_nonequi", """
from: {name: nation, as: n}
columns: [{field: n_name, source: n}, {query: {as: below, from: {name: nation, as: m}, where: {and: [{op: ==, left: {field: n_regionkey, source: m}, right: {field: n_regionkey, source: n}}, {op: "<", left: {field: n_nationkey, source: m}, right: {field: n_nationkey, source: n}}]}, columns: [{aggregate: {function: count, args: [{star: true}]}, as: k}]}}]
""", "SELECT n_name, (SELECT count(*) FROM nation m WHERE m.n_regionkey = n.n_regionkey AND m.n_nationkey < n.n_nationkey) AS below FROM nation n", dialect="R")

document("sub_exists_or", """
from: {name: customer, as: c}
where: {or: [{op: "<", left: {field: c_custkey, source: c}, right: {value: 20}}, {exists: {query: {from: {name: supplier, as: s}, where: {op: ==, left: {field: s_suppkey, source: s}, right: {field: c_custkey, source: c}}}}}]}
columns: [{field: c_custkey, source: c}]
""", "SELECT c_custkey FROM customer WHERE c_custkey < 20 OR EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = c_custkey)", dialect="R")

document("rec_group_expr", """
from: {name: orders, as: o}
groupBy: [{binary: {op: "*", left: {field: o_custkey, source: o}, right: {value: 0}}}]
columns: [{aggregate: {function: count, args: [{star: true}]}, as: n}, {aggregate: {function: max, args: [{field: o_orderkey, source: o}]}, as: m}]
""", "SELECT count(*) AS n, max(o_orderkey) AS m FROM orders", dialect="R")

document("rec_div_zero", """
from: {name: lineitem, as: l}
where: {op: ==, left: {binary: {op: /, left: {field: l_quantity, source: l}, right: {field: l_discount, source: l}}}, right: {binary: {op: /, left: {value: 1}, right: {value: 0}}}}
columns: [{field: l_orderkey, source: l}, {field: l_partkey, source: l}]
""", "SELECT l_orderkey, l_partkey FROM lineitem WHERE l_discount = 0", dialect="R")
