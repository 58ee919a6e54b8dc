"""A fluent, immutable query builder over one collection; it builds a dict and a DataFrame."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeframe.errors import QueryError
from lodeframe.functions.keys import Key

#: Stands for a record's own key.
DOCUMENT_ID = "__name__"
OPERATORS = ["==", "!=", "<", "<=", ">", ">=", "in", "not-in", "array-contains", "array-contains-any"]


@dataclass(frozen=True)
class QueryBuilder:
    """collection("orders").where("o_custkey", "==", 7).order_by("o_orderkey").limit(10).frame(df)."""

    name: str
    parent: Key | None = None
    group: bool = False
    filters: tuple[tuple[str, str, Any], ...] = ()
    orders: tuple[tuple[str, bool], ...] = ()
    count: int | None = None
    skip: int | None = None
    cursors: tuple[tuple[str, tuple[Any, ...]], ...] = field(default=())

    def where(self, name: str, op: str, value: Any) -> QueryBuilder:
        if op not in OPERATORS:
            raise QueryError("query_shape", "where", f"unknown operator {op}")
        return replace(self, filters=(*self.filters, (name, op, value)))

    def order_by(self, name: str, direction: str = "asc") -> QueryBuilder:
        if direction not in ("asc", "desc"):
            raise QueryError("query_shape", "orderBy", "asc or desc")
        return replace(self, orders=(*self.orders, (name, direction == "desc")))

    def limit(self, n: int) -> QueryBuilder:
        if isinstance(n, bool) or not isinstance(n, int) or n < 1:
            raise QueryError("query_shape", "limit", "a positive whole number")
        return replace(self, count=n)

    def offset(self, n: int) -> QueryBuilder:
        if isinstance(n, bool) or not isinstance(n, int) or n < 0:
            raise QueryError("query_shape", "offset", "a whole number")
        return replace(self, skip=n)

    def _cursor(self, kind: str, values: tuple[Any, ...]) -> QueryBuilder:
        if not values or len(values) > len(self.orders):
            raise QueryError("query_shape", kind, "one value for each of the first order keys")
        return replace(self, cursors=(*(c for c in self.cursors if c[0][:3] != kind[:3]), (kind, values)))

    def start_at(self, *values: Any) -> QueryBuilder:
        return self._cursor("startAt", values)

    def start_after(self, *values: Any) -> QueryBuilder:
        return self._cursor("startAfter", values)

    def end_at(self, *values: Any) -> QueryBuilder:
        return self._cursor("endAt", values)

    def end_before(self, *values: Any) -> QueryBuilder:
        return self._cursor("endBefore", values)

    def build(self) -> dict[str, Any]:
        source: dict[str, Any] = {"kind": "group" if self.group else "collection", "name": self.name}
        if self.parent is not None:
            source["parent"] = self.parent.path
        out: dict[str, Any] = {"source": source, "filters": [{"field": f, "op": o, "value": v} for f, o, v in self.filters], "orders": [{"field": f, "desc": d} for f, d in self.orders]}
        return out | {k: v for k, v in (("limit", self.count), ("offset", self.skip)) if v is not None} | {k: list(v) for k, v in self.cursors}

    def frame(self, df: DataFrame) -> DataFrame:
        """The query over a collection's rows. A parent keeps rows whose _parent_path is its path."""
        if self.parent is not None and not self.group:
            df = df.where(F.col("_parent_path") == self.parent.path)
        for f, op, value in self.filters:
            df = df.where(predicate(_column(f), op, value))
        for kind, values in self.cursors:
            df = df.where(cursor_predicate([(_column(f), d) for f, d in self.orders[: len(values)]], kind, values))
        if self.orders:
            df = df.orderBy(*[_column(f).desc_nulls_last() if d else _column(f).asc_nulls_first() for f, d in self.orders])
        if self.skip:
            df = df.offset(self.skip)
        return df if self.count is None else df.limit(self.count)


def _column(name: str) -> Column:
    return F.col("_key") if name == DOCUMENT_ID else F.col(f"`{name}`")


def predicate(c: Column, op: str, value: Any) -> Column:
    """One filter; == null and != null are null tests."""
    if value is None and op in ("==", "!="):
        return c.isNull() if op == "==" else c.isNotNull()
    if op == "in":
        return c.isin(*value) if value else F.lit(False)
    if op == "not-in":
        return ~c.isin(*value) if value else F.lit(True)
    if op == "array-contains":
        return F.array_contains(c, value)
    if op == "array-contains-any":
        return F.arrays_overlap(c, F.array(*[F.lit(v) for v in value])) if value else F.lit(False)
    return {"==": c == value, "!=": c != value, "<": c < value, "<=": c <= value, ">": c > value, ">=": c >= value}[op]


def cursor_predicate(keys: list[tuple[Column, bool]], kind: str, values: tuple[Any, ...]) -> Column:
    """Rows from (or to) a place in the order, by the lexicographic order of its keys; null is the least value."""
    start, inclusive = kind.startswith("start"), kind.endswith("At")

    def beyond(c: Column, desc: bool, v: Any) -> Column:
        after = start != desc
        if v is None:
            return c.isNotNull() if after else F.lit(False)
        return F.coalesce(c > F.lit(v), F.lit(False)) if after else F.coalesce(c < F.lit(v), F.lit(True))

    options, same = [], F.lit(True)
    for (c, desc), v in zip(keys, values, strict=False):
        options.append(same & beyond(c, desc, v))
        same = same & c.eqNullSafe(F.lit(v))
    if inclusive:
        options.append(same)
    return reduce(lambda a, b: a | b, options)


def collection(name: str, parent: Key | None = None) -> QueryBuilder:
    if not name or "/" in name:
        raise QueryError("query_shape", "collection", "one non-empty segment")
    return QueryBuilder(name, parent)


def collection_group(name: str) -> QueryBuilder:
    """All collections of a name, whatever their parent."""
    return replace(collection(name), group=True)
