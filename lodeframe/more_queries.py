"""Registered queries of the text language, builder, money, lookups and keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeframe.builder import collection
from lodeframe.functions.keys import Key, key_column
from lodeframe.functions.money import money_avg, money_sum
from lodeframe.operators.lookup import enrich, lookup
from lodeframe.plans.resolve import Context, text_frame
from lodeframe.plans.run import to_frame
from lodeframe.queries import _QUERIES, _SQL, catalog, document, register
from lodeframe.sources.catalog import Catalog, Relationship
from lodeframe.sources.records import Session, keyed


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text(name: str, source: str, sql: str, context: Context | None = None, relationships: tuple[Relationship, ...] = ()) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = catalog(spark, sf_dir)
        for r in relationships:
            c.add_relationship(r)
        return text_frame(c, source, context)

    _QUERIES[name], _SQL[name] = run, sql


text("text_cte", """
with Busy as (
  from orders as o
  group by o.o_custkey
  select o.o_custkey, COUNT(*) as N
)
from customer as c
join Busy as b on b.o_custkey = c.c_custkey
where b.N >= 12 and (c.c_acctbal > 0 or c.c_mktsegment is null)
order by b.N desc, c.c_custkey
limit 40
select c.c_custkey, b.N
""", "SELECT c_custkey, N FROM customer JOIN (SELECT o_custkey, count(*) AS N FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey WHERE N >= 12 AND c_acctbal > 0 ORDER BY N DESC, c_custkey LIMIT 40")

text("text_params", """
parameters (
  @Least integer default 40
  @Flag string required
)
from lineitem as l
where l.l_quantity >= @Least and l.l_returnflag = @Flag
select l.l_orderkey, l.l_partkey, l.l_quantity * 2 as Twice
""", "SELECT l_orderkey, l_partkey, l_quantity * 2 AS Twice FROM lineitem WHERE l_quantity >= 40 AND l_returnflag = 'A'", Context(bindings={"Flag": "A"}))

_LINKS = (Relationship("customer-nation", "customer", "nation", (("c_nationkey", "n_nationkey"),)), Relationship("nation-region", "nation", "region", (("n_regionkey", "r_regionkey"),)))

text("text_relationship_join", """
FROM customer AS c
JOIN nation AS n
LEFT JOIN region AS r
WHERE n.n_nationkey < 9
SELECT c.c_custkey, n.n_name, r.r_name
""", "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey < 9", None, _LINKS)

text("text_default_projection", """
from nation as n
join region as r
where r.r_regionkey > 1
""", "SELECT n_nationkey, n_name, n_regionkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey > 1", None, _LINKS)

text("text_scalar_block", """
from nation as n
select (
  n.n_name
  Suppliers as (
    from supplier as s
    where s.s_nationkey = n.n_nationkey
    select COUNT(*) as K
  )
)
""", "SELECT n_name, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS Suppliers FROM nation")

text("text_import", """
with Big from './big.txt'
using ( @Size = 45 )
from Big
group by p_brand
having COUNT(*) > 1
select p_brand, COUNT(*) as N
""", "SELECT p_brand, count(*) AS N FROM part WHERE p_size > 45 GROUP BY p_brand HAVING count(*) > 1", Context(imports={"big.txt": "parameters (\n  @Size integer required\n)\nfrom part as p\nwhere p.p_size > @Size\nselect p.p_brand, p.p_partkey\n"}))

document("rec_first_row_values", """
from: {name: orders, as: o}
groupBy: [{field: o_orderpriority, source: o}]
having: {op: ">", left: {aggregate: {function: count, args: [{star: true}]}}, right: {value: 1}}
columns: [{field: o_orderpriority, source: o}, {field: o_custkey, source: o}, {field: o_orderstatus, source: o}, {aggregate: {function: count, args: [{field: o_custkey, source: o}], distinct: true}, as: n}]
""", "SELECT o_orderpriority, first(o_custkey ORDER BY o_orderkey) AS o_custkey, first(o_orderstatus ORDER BY o_orderkey) AS o_orderstatus, count(DISTINCT o_custkey) AS n FROM orders GROUP BY o_orderpriority HAVING count(*) > 1", dialect="R")

document("money_document", """
from: {name: part}
groupBy: [{field: p_brand}]
columns:
  - {field: p_brand}
  - {aggregate: {function: sum, args: [{field: p_size}]}, as: total}
  - {aggregate: {function: avg, args: [{field: p_size}]}, as: mean}
  - {aggregate: {function: count, args: [{star: true}]}, as: n}
money: {minorUnitScale: 0, divisionScale: 2, rounding: halfEven}
""", """
SELECT p_brand, CAST(s AS VARCHAR) AS total, regexp_replace(rtrim(printf('%d.%02d', cents // 100, cents % 100), '0'), '\\.$', '') AS mean, n
FROM (SELECT *, (s * 100) // n + CASE WHEN 2 * ((s * 100) % n) > n OR (2 * ((s * 100) % n) = n AND ((s * 100) // n) % 2 = 1) THEN 1 ELSE 0 END AS cents
      FROM (SELECT p_brand, sum(p_size)::BIGINT AS s, count(*) AS n FROM part GROUP BY p_brand))""")

document("money_quotient", """
from: {name: lineitem}
columns:
  - {field: l_orderkey}
  - {field: l_linenumber}
  - {binary: {op: /, left: {field: l_linenumber}, right: {value: 8}}, as: share}
money: {minorUnitScale: 0, divisionScale: 2, rounding: halfEven}
""", """
SELECT l_orderkey, l_linenumber, regexp_replace(rtrim(CAST(CAST(round_even(l_linenumber / 8, 2) AS DECIMAL(18, 2)) AS VARCHAR), '0'), '\\.$', '') AS share FROM lineitem""")


@register("money_sum", """
SELECT c_nationkey, regexp_replace(rtrim(CAST(sum(CAST(round(c_acctbal, 2) AS DECIMAL(18,2))) AS VARCHAR), '0'), '\\.$', '') AS total, count(*) AS n
FROM customer GROUP BY c_nationkey""")
def money_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    amount = F.round("c_acctbal", 2).cast("decimal(18,2)").cast("string")
    return _table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(money_sum(amount, 2).alias("total"), F.count("*").alias("n"))


@register("money_average", """
SELECT CAST(floor((s * 100 + n / 2) / n) AS BIGINT) - CASE WHEN (s * 100) % n * 2 = n AND CAST(floor((s * 100 + n / 2) / n) AS BIGINT) % 2 = 1 THEN 1 ELSE 0 END AS cents, n
FROM (SELECT sum(p_size)::BIGINT AS s, count(*) AS n, p_brand FROM part GROUP BY p_brand)""")
def money_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = _table(spark, sf_dir, "part").groupBy("p_brand").agg(money_avg(F.col("p_size").cast("string"), 0, 2).alias("mean"), F.count("*").alias("n"))
    return by.select((F.col("mean").cast("decimal(20,2)") * 100).cast("bigint").alias("cents"), "n")


@register("cursor_start_after", """
SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey < 70 OR (o_custkey = 70 AND o_orderkey > 100) ORDER BY o_custkey DESC, o_orderkey LIMIT 30""")
def cursor_start_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = collection("orders").order_by("o_custkey", "desc").order_by("o_orderkey").start_after(70, 100).limit(30)
    return q.frame(_table(spark, sf_dir, "orders")).select("o_orderkey", "o_custkey")


@register("cursor_between", "SELECT event_id FROM events WHERE event_id >= 10 AND event_id < 25")
def cursor_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collection("events").order_by("event_id").start_at(10).end_before(25).frame(_table(spark, sf_dir, "events")).select("event_id")


@register("builder_array_contains", "SELECT vec_id FROM embeddings WHERE label IN (2, 3)")
def builder_array_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "embeddings").withColumn("tags", F.array("label", F.col("label") + 1))
    return collection("embeddings").where("tags", "array-contains", 3).frame(df).select("vec_id")


@register("lookup_enrich", "SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def lookup_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = enrich(_table(spark, sf_dir, "orders"), _table(spark, sf_dir, "customer"), {"o_custkey": "c_custkey"}, columns=["c_name"])
    return out.select("o_orderkey", "c_name")


@register("lookup_service", "SELECT n_nationkey, upper(n_name) AS label FROM nation")
def lookup_service(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return lookup(df, lambda r: r["n_name"], str.upper, lambda r, v: {"n_nationkey": r["n_nationkey"], "label": v}, "n_nationkey int, label string")


@register("key_paths", "SELECT 'orders/' || CAST(o_orderkey AS VARCHAR) AS path FROM orders")
def key_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").select(key_column("orders", F.col("o_orderkey")).alias("path"))


@register("records_set", "SELECT n_nationkey, CASE WHEN n_nationkey < 3 THEN 'new' ELSE n_name END AS n_name FROM nation")
def records_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = keyed(_table(spark, sf_dir, "nation"), "nation", "n_nationkey")
    new = df.where("n_nationkey < 3").withColumn("n_name", F.lit("new"))
    return Session(df).set(new).df.select("n_nationkey", "n_name")


def federated(name: str, body: str, sql: str) -> None:
    """A document over tables of two databases: people (customer, nation) and trade (orders)."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = Catalog(spark).add_parquet(sf_dir, ["customer", "nation"], database="people").add_parquet(sf_dir, ["orders"], database="trade")
        return to_frame(c, body, dialect="J")

    _QUERIES[name], _SQL[name] = run, sql


federated("federated_join", """
from: {database: trade, name: orders, as: o, joins: [{from: {database: people, name: customer, as: c, joins: [{from: {database: people, name: nation, as: n}, on: [{left: {field: c_nationkey, source: c}, op: ==, right: {field: n_nationkey, source: n}}]}]}, on: [{left: {field: o_custkey, source: o}, op: ==, right: {field: c_custkey, source: c}}]}]}
groupBy: [{field: n_name}, {field: o_orderpriority}]
columns: [{field: n_name}, {field: o_orderpriority}, {aggregate: {function: count, args: [{star: true}]}, as: n}]
""", "SELECT n_name, o_orderpriority, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name, o_orderpriority")


@register("federated_resolver", "SELECT c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_acctbal < 0")
def federated_resolver(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lambda r: _table(spark, sf_dir, r["name"]) if r.get("database") == "trade" else None
    c = Catalog(spark, resolver=found).add_parquet(sf_dir, ["customer"])
    return to_frame(c, """
from: {name: customer, as: c, joins: [{from: {database: trade, name: orders, as: o}, on: [{left: {field: c_custkey, source: c}, op: ==, right: {field: o_custkey, source: o}}]}]}
where: {op: "<", left: {field: c_acctbal}, right: {value: 0}}
columns: [{field: c_custkey}, {field: o_orderkey}]
""", dialect="J")


document("join_left_in_left_outer_key", """
from: {name: nation, as: n, joins: [{type: left, from: {name: supplier, as: s, joins: [{type: left, from: {name: customer, as: c}, on: [{left: {field: c_nationkey, source: c}, op: ==, right: {field: n_regionkey, source: n}}, {left: {field: c_custkey, source: c}, op: ==, right: {field: s_suppkey, source: s}}]}]}, on: [{left: {field: s_nationkey, source: s}, op: ==, right: {field: n_nationkey, source: n}}]}]}
columns: [{field: n_name}, {field: s_suppkey}, {field: c_name}]
""", "SELECT n_name, s_suppkey, c_name FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey LEFT JOIN customer ON c_nationkey = n_regionkey AND c_custkey = s_suppkey")

document("derived_correlated_latest", """
from: {name: customer, as: c, joins: [{type: left, from: {query: {as: d, from: {name: orders, as: o}, where: {op: ==, left: {field: o_custkey, source: o}, right: {field: c_custkey, source: c}}, orderBy: [{field: o_orderkey, source: o, desc: true}], limit: 2, columns: [{field: o_custkey, source: o}, {field: o_orderkey, source: o}]}}, on: [{left: {field: o_custkey, source: d}, op: ==, right: {field: c_custkey, source: c}}]}]}
columns: [{field: c_custkey, source: c}, {field: o_orderkey, source: d}]
""", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) <= 2) ON o_custkey = c_custkey", dialect="R")

document("sub_scalar_corr_latest", """
from: {name: customer, as: c}
columns: [{field: c_custkey, source: c}, {query: {as: latest, from: {name: orders, as: o}, where: {op: ==, left: {field: o_custkey, source: o}, right: {field: c_custkey, source: c}}, orderBy: [{field: o_totalprice, source: o, desc: true}, {field: o_orderkey, source: o}], limit: 1, columns: [{field: o_orderkey, source: o}]}}]
""", "SELECT c_custkey, (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) AS latest FROM customer", dialect="R")

document("derived_correlated_sum", """
from: {name: part, as: p, joins: [{from: {query: {as: d, from: {name: lineitem, as: l}, where: {and: [{op: ==, left: {field: l_partkey, source: l}, right: {field: p_partkey, source: p}}, {op: "<", left: {field: l_quantity, source: l}, right: {field: p_size, source: p}}]}, groupBy: [{field: l_partkey, source: l}], columns: [{field: l_partkey, source: l}, {aggregate: {function: sum, args: [{field: l_quantity, source: l}]}, as: held}]}}, on: [{left: {field: l_partkey, source: d}, op: ==, right: {field: p_partkey, source: p}}]}]}
columns: [{field: p_partkey, source: p}, {field: held, source: d}]
""", "SELECT p_partkey, sum(l_quantity) AS held FROM part JOIN lineitem ON l_partkey = p_partkey AND l_quantity < p_size GROUP BY p_partkey", dialect="R")

document("rec_first_last_skip_null", """
from: {name: documents, as: d, joins: [{type: left, from: {name: labels, as: l}, on: [{left: {field: doc_id, source: d}, op: ==, right: {field: doc_id, source: l}}]}]}
groupBy: [{field: lang, source: d}]
columns: [{field: lang, source: d}, {aggregate: {function: first, args: [{field: quality, source: l}]}, as: first_quality}, {aggregate: {function: last, args: [{field: toxic, source: l}]}, as: last_toxic}]
""", "SELECT d.lang, first(quality ORDER BY d.doc_id) FILTER (quality IS NOT NULL) AS first_quality, last(toxic ORDER BY d.doc_id) FILTER (toxic IS NOT NULL) AS last_toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.lang", dialect="R")

document("filter_ne_three_valued", """
from: {name: documents, as: d, joins: [{type: left, from: {name: labels, as: l}, on: [{left: {field: doc_id, source: d}, op: ==, right: {field: doc_id, source: l}}]}]}
where: {op: "!=", left: {field: quality, source: l}, right: {value: 1}}
columns: [{field: doc_id, source: d}, {field: quality, source: l}]
""", "SELECT d.doc_id, quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE quality <> 1", dialect="R")


@register("builder_array_contains_any", "SELECT vec_id FROM embeddings WHERE label IN (1, 2, 6, 7)")
def builder_array_contains_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "embeddings").withColumn("tags", F.array("label", F.col("label") + 1))
    return collection("embeddings").where("tags", "array-contains-any", [2, 7]).frame(df).select("vec_id")


@register("builder_cursor_desc", "SELECT o_orderkey FROM orders WHERE o_orderkey <= 900 AND o_orderkey > 300")
def builder_cursor_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collection("orders").order_by("o_orderkey", "desc").start_at(900).end_before(300).frame(_table(spark, sf_dir, "orders")).select("o_orderkey")


@register("records_get_many", "SELECT * FROM (VALUES (0, 'nation/3', true), (1, 'nation/99', false), (2, 'nation/1', true)) t(place, path, found)")
def records_get_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = keyed(_table(spark, sf_dir, "nation"), "nation", "n_nationkey")
    out = Session(df).get_many([Key("nation", i) for i in (3, 99, 1)])
    return out.select(F.col("_at").cast("int").alias("place"), F.col("_key").alias("path"), F.col("_exists").alias("found"))


@register("records_insert_update_delete", """
SELECT n_nationkey, CASE WHEN n_nationkey = 2 THEN 'renamed' ELSE n_name END AS n_name FROM nation WHERE n_nationkey NOT IN (4, 5)
UNION ALL SELECT n_nationkey + 1000, n_name FROM nation WHERE n_nationkey < 3""")
def records_insert_update_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _table(spark, sf_dir, "nation")
    more = keyed(table.where("n_nationkey < 3").withColumn("n_nationkey", F.col("n_nationkey") + 1000), "nation", "n_nationkey")
    new = Session(keyed(table, "nation", "n_nationkey")).insert(more).update(Key("nation", 2), {"n_name": "renamed"}).delete([Key("nation", 4), Key("nation", 5)])
    return new.df.select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name")
