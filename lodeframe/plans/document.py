"""Query documents: YAML, JSON or Python objects, checked against closed key sets and written back canonically.

Dialect J (flat): joined relations, typed literals, one level. Dialect R (recursive): subqueries in FROM, JOIN, WHERE
and columns. parse() returns a Query whose body compile.py takes as it is.
"""

from __future__ import annotations

import copy
import json
import math
import re
from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

import yaml

from lodeframe.errors import QueryError

QUERY_KEYS = ["from", "where", "groupBy", "having", "orderBy", "limit", "offset", "columns", "money"]
RELATION_KEYS = ["database", "schema", "name", "alias", "as", "scan", "joins"]
JOIN_KEYS = ["type", "from", "on", "hints"]
OPERATORS = ["==", "eq", "!=", "<", "<=", ">", ">=", "In", "NotIn"]
R_OPERATORS = [*OPERATORS, "in", "not-in"]
ALGORITHMS = ["hash", "merge", "lookup", "batchedLookup", "nestedLoop"]
FUNCTIONS = ["count", "sum", "avg", "min", "max", "first", "last"]
MAX_LIMIT, MAX_SCAN = 1000, 10_000


@dataclass(frozen=True)
class Query:
    """A checked document and its dialect, J or R."""

    body: dict[str, Any]
    dialect: str = "J"

    def to_dict(self) -> dict[str, Any]:
        return canonical(self.body)

    def to_yaml(self) -> str:
        return yaml.safe_dump(self.to_dict(), sort_keys=False, allow_unicode=True)


class _UniqueKeys(yaml.SafeLoader):
    pass


def _mapping(loader: yaml.SafeLoader, node: yaml.MappingNode) -> dict[Any, Any]:
    out: dict[Any, Any] = {}
    for key_node, value_node in node.value:
        key = loader.construct_object(key_node, deep=True)
        if key in out:
            raise QueryError("query_shape", str(key), "the key occurs twice")
        out[key] = loader.construct_object(value_node, deep=True)
    return out


_UniqueKeys.add_constructor(yaml.resolver.BaseResolver.DEFAULT_MAPPING_TAG, _mapping)
# Dates stay text, and only true and false are booleans (`on` is a key), as JSON has them
_UniqueKeys.yaml_implicit_resolvers = {k: [(t, r) for t, r in v if t not in ("tag:yaml.org,2002:timestamp", "tag:yaml.org,2002:bool")] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()}
_UniqueKeys.add_implicit_resolver("tag:yaml.org,2002:bool", re.compile("^(?:true|True|TRUE|false|False|FALSE)$"), list("tTfF"))


def load(source: str | Mapping[str, Any]) -> dict[str, Any]:
    if isinstance(source, str):
        try:
            source = yaml.load(source, Loader=_UniqueKeys)  # noqa: S506  a safe loader
        except yaml.YAMLError as e:
            raise QueryError("query_shape", "document", f"not YAML: {e}") from e
    if not isinstance(source, Mapping):
        raise QueryError("query_shape", "document", "a query is a mapping")
    return copy.deepcopy(dict(source))


def parse(source: str | Mapping[str, Any], *, dialect: str | None = None, max_limit: int = MAX_LIMIT) -> Query:
    """A checked Query. Without a dialect, documents with subqueries are R and all others J."""
    body = load(source)
    if dialect is None:
        dialect = "R" if _has_query(body) else "J"
    return Query(_Checker(dialect, max_limit).query(body, ""), dialect)


def _has_query(x: Any) -> bool:
    if isinstance(x, Mapping):
        return "query" in x or "exists" in x or "notExists" in x or any(_has_query(v) for v in x.values())
    return isinstance(x, list) and any(_has_query(v) for v in x)


class _Checker:
    def __init__(self, dialect: str, max_limit: int):
        self.j, self.max_limit = dialect == "J", max_limit

    def fail(self, path: str, reason: str, code: str | None = None) -> QueryError:
        return QueryError(code or ("join_shape" if self.j else "shape"), path or "document", reason)

    def closed(self, x: Any, keys: list[str], path: str) -> dict[str, Any]:
        if not isinstance(x, Mapping):
            raise self.fail(path, "not a mapping")
        for k in x:
            if k not in keys:
                raise self.fail(f"{path}.{k}" if path else str(k), "unknown key")
        return {k: v for k, v in x.items() if v is not None}

    def query(self, q: Any, path: str, *, named: bool = False) -> dict[str, Any]:
        keys = QUERY_KEYS if self.j else [k for k in QUERY_KEYS if k != "money"] + ["as"]
        q = self.closed(q, keys, path)
        at = lambda k: f"{path}.{k}" if path else k
        if "from" not in q:
            raise self.fail(at("from"), "missing")
        if named and not q.get("as"):
            raise self.fail(at("as"), "a nested query needs a name")
        out: dict[str, Any] = {}
        if q.get("as"):
            out["as"] = q["as"]
        out["from"] = self.relation(q["from"], at("from"), set())
        if "where" in q:
            out["where"] = self.condition(q["where"], at("where"))
        columns = [self.column(c, f"{at('columns')}[{i}]") for i, c in enumerate(self.items(q, "columns", path))]
        aliases = {c["as"]: {k: v for k, v in c.items() if k != "as"} for c in columns if c.get("as")}
        groups = [self.group(k, f"{at('groupBy')}[{i}]") for i, k in enumerate(self.items(q, "groupBy", path))]
        if groups:
            out["groupBy"] = groups
        if "having" in q:
            out["having"] = _substituted(self.condition(q["having"], at("having")), aliases)
        keys_ = [self.order_key(k, f"{at('orderBy')}[{i}]", aliases) for i, k in enumerate(self.items(q, "orderBy", path))]
        if keys_:
            out["orderBy"] = keys_
        if "limit" in q:
            n = self.whole(q["limit"], at("limit"), 0 if self.j else 1, self.max_limit if self.j else 10_000)
            if n:
                out["limit"] = n
        if "offset" in q:
            out["offset"] = self.whole(q["offset"], at("offset"), 0, 2**53)
        if columns:
            out["columns"] = columns
        if "money" in q:
            m = self.closed(q["money"], ["minorUnitScale", "divisionScale", "rounding"], at("money"))
            out["money"] = {"minorUnitScale": self.whole(m.get("minorUnitScale"), at("money.minorUnitScale"), 0, 18), "divisionScale": self.whole(m.get("divisionScale"), at("money.divisionScale"), 0, 18), "rounding": m.get("rounding", "halfEven")}
            if out["money"]["rounding"] != "halfEven":
                raise self.fail(at("money.rounding"), "only halfEven")
        return out

    def items(self, q: Mapping[str, Any], key: str, path: str) -> list[Any]:
        v = q.get(key) or []
        if not isinstance(v, list):
            raise self.fail(f"{path}.{key}" if path else key, "not a list")
        return v

    def whole(self, v: Any, path: str, least: int, most: int) -> int:
        if isinstance(v, bool) or not isinstance(v, int) or not least <= v <= most:
            raise self.fail(path, f"a whole number from {least} to {most}")
        return v

    def name(self, v: Any, path: str) -> str:
        if not isinstance(v, str) or not v.strip():
            raise self.fail(path, "a non-empty name")
        return v

    def relation(self, r: Any, path: str, seen: set[str]) -> dict[str, Any]:
        if isinstance(r, Mapping) and "query" in r and not self.j:
            r = self.closed(r, ["query", "joins", "as", "alias"], path)
            inner = dict(r["query"])
            inner.setdefault("as", r.get("as") or r.get("alias"))
            out: dict[str, Any] = {"query": self.query(inner, f"{path}.query", named=True)}
            alias = out["query"]["as"]
        else:
            if self.j and isinstance(r, Mapping) and "query" in r:
                raise self.fail(f"{path}.query", "no subqueries in a flat document")
            r = self.closed(r, RELATION_KEYS if self.j else [k for k in RELATION_KEYS if k != "scan"], path)
            out = {k: self.name(r[k], f"{path}.{k}") for k in ("database", "schema", "name", "alias", "as") if k in r}
            if "name" not in out:
                raise self.fail(f"{path}.name", "missing")
            if "as" in out:
                out["alias"] = out.pop("as")
            alias = out.get("alias", out["name"])
            if "scan" in r:
                s = self.closed(r["scan"], ["orderBy", "limit"], f"{path}.scan")
                if not s.get("orderBy"):
                    raise self.fail(f"{path}.scan.orderBy", "missing")
                out["scan"] = {"orderBy": [self.closed(k, ["field", "desc"], f"{path}.scan.orderBy") for k in s["orderBy"]], "limit": self.whole(s.get("limit"), f"{path}.scan.limit", 1, MAX_SCAN)}
        if alias in seen:
            raise self.fail(path, f"duplicate alias {alias}", "join_scope")
        seen.add(alias)
        joins = [self.join(j, f"{path}.joins[{i}]", seen) for i, j in enumerate(self.items(r, "joins", path))]
        if joins:
            out["joins"] = joins
        return out

    def join(self, j: Any, path: str, seen: set[str]) -> dict[str, Any]:
        j = self.closed(j, JOIN_KEYS, path)
        kind = j.get("type", "inner")
        if kind not in ("inner", "left"):
            raise self.fail(f"{path}.type", "inner or left", "join_type")
        out: dict[str, Any] = {"type": kind, "from": self.relation(j.get("from"), f"{path}.from", seen)}
        if not j.get("on"):
            raise self.fail(f"{path}.on", "at least one predicate")
        out["on"] = []
        for i, p in enumerate(j["on"]):
            at = f"{path}.on[{i}]"
            p = self.closed(p, ["left", "op", "right"], at)
            if p.get("op", "==") not in ("==", "eq"):
                raise self.fail(f"{at}.op", "only ==", "join_operator")
            sides = {s: self.closed(p.get(s), ["field", "source"], f"{at}.{s}") for s in ("left", "right")}
            for side, s in sides.items():
                if s.get("source") is not None and s["source"] not in seen:
                    raise self.fail(f"{at}.{side}.source", f"source alias {s['source']} is not in scope", "join_scope")
            out["on"].append({"left": sides["left"], "op": "==", "right": sides["right"]})
        if j.get("hints"):
            names = self.closed(j["hints"], ["algorithms"], f"{path}.hints").get("algorithms") or []
            if len(set(names)) < len(names) or not set(names) <= set(ALGORITHMS) or not names:
                raise self.fail(f"{path}.hints.algorithms", "different known algorithms", "join_algorithm")
            out["hints"] = {"algorithms": list(names)}
        return out

    def condition(self, c: Any, path: str) -> dict[str, Any]:
        if not isinstance(c, Mapping):
            raise self.fail(path, "not a condition", "query_shape" if self.j else None)
        for word in ("and", "or"):
            if word in c:
                self.closed(c, [word], path)
                if not isinstance(c[word], list) or not c[word]:
                    raise self.fail(f"{path}.{word}", "a non-empty list")
                return {word: [self.condition(x, f"{path}.{word}[{i}]") for i, x in enumerate(c[word])]}
        for word in ("isNull", "isNotNull"):
            if word in c:
                self.closed(c, [word], path)
                return {word: self.expression(c[word], f"{path}.{word}", query=True)}
        for word in ("exists", "notExists"):
            if word in c:
                if self.j:
                    raise self.fail(f"{path}.{word}", "no subqueries in a flat document")
                self.closed(c, [word], path)
                return {word: {"query": self.query(self.closed(c[word], ["query"], f"{path}.{word}").get("query"), f"{path}.{word}.query")}}
        c = self.closed(c, ["op", "left", "right"], path)
        if c.get("op") not in (OPERATORS if self.j else R_OPERATORS):
            raise self.fail(f"{path}.op", "unknown operator")
        member = c["op"] in ("In", "NotIn", "in", "not-in")
        return {"op": "==" if c["op"] == "eq" else c["op"], "left": self.expression(c.get("left"), f"{path}.left"), "right": self.expression(c.get("right"), f"{path}.right", query=member, values=True)}

    def scalar(self, v: Any, path: str) -> Any:
        if v is not None and not isinstance(v, (str, int, float, bool)) or isinstance(v, float) and not math.isfinite(v):
            raise self.fail(path, "a string, number, boolean or null")
        return v

    def expression(self, e: Any, path: str, *, query: bool = False, values: bool = False) -> dict[str, Any]:
        if not isinstance(e, Mapping):
            raise self.fail(path, "not an expression")
        if "field" in e:
            e = self.closed(e, ["field", "source"], path)
            return {"field": self.name(e["field"], f"{path}.field"), **({"source": self.name(e["source"], f"{path}.source")} if "source" in e else {})}
        if "value" in e:
            if set(e) != {"value"}:
                raise self.fail(path, "unknown key")
            return {"value": self.scalar(e["value"], f"{path}.value")}
        if "values" in e:
            e = self.closed(e, ["values"], path)
            return {"values": [self.scalar(v, f"{path}.values[{i}]") for i, v in enumerate(e["values"])]}
        if "param" in e and self.j:
            return {"param": self.name(self.closed(e, ["param"], path)["param"], f"{path}.param")}
        if "star" in e:
            return {"star": True}
        if "binary" in e:
            b = self.closed(self.closed(e, ["binary"], path)["binary"], ["op", "left", "right"], f"{path}.binary")
            if b.get("op") not in ("+", "-", "*", "/"):
                raise self.fail(f"{path}.binary.op", "one of + - * /")
            return {"binary": {"op": b["op"], "left": self.expression(b.get("left"), f"{path}.binary.left"), "right": self.expression(b.get("right"), f"{path}.binary.right")}}
        if "aggregate" in e:
            return {"aggregate": self.aggregate(self.closed(e, ["aggregate"], path)["aggregate"], f"{path}.aggregate")}
        if "query" in e and not self.j:
            if not query:
                raise self.fail(f"{path}.query", "no scalar query here")
            return {"query": self.query(self.closed(e, ["query"], path)["query"], f"{path}.query")}
        raise self.fail(path, "unknown expression" if not (self.j and "query" in e) else "no subqueries in a flat document")

    def aggregate(self, a: Any, path: str) -> dict[str, Any]:
        bad = lambda reason: QueryError("join_aggregate" if self.j else "shape", path, reason)
        a = self.closed(a, ["function", "args", "distinct"], path)
        name = str(a.get("function", "")).lower()
        if name not in FUNCTIONS:
            raise bad("unknown function")
        if len(a.get("args") or ()) != 1:
            raise bad("one argument")
        argument = self.expression(a["args"][0], f"{path}.args[0]")
        if argument.get("star") and (name != "count" or a.get("distinct")):
            raise bad("* only in count(*)")
        if a.get("distinct") and name in ("min", "max", "first", "last"):
            raise bad("no distinct here")
        if _holds(argument, "aggregate"):
            raise bad("nested aggregates")
        return {"function": name, "args": [argument], **({"distinct": True} if a.get("distinct") else {})}

    def column(self, c: Any, path: str) -> dict[str, Any]:
        if not isinstance(c, Mapping):
            raise self.fail(path, "not a column")
        if "wildcard" in c and self.j:
            w = self.closed(self.closed(c, ["wildcard"], path)["wildcard"], ["source", "exclude"], f"{path}.wildcard")
            if not w.get("exclude"):
                raise self.fail(f"{path}.wildcard.exclude", "a non-empty list")
            return {"wildcard": w}
        name = c.get("as")
        out = self.expression({k: v for k, v in c.items() if k != "as"}, path, query=True)
        if name is not None:
            out = {**out, "as": self.name(name, f"{path}.as")}
        elif "query" in out and not out["query"].get("as") or "value" in out or "binary" in out:
            raise self.fail(path, "the column needs an alias", "join_plan" if self.j else None)
        return out

    def group(self, k: Any, path: str) -> dict[str, Any]:
        if self.j and not (isinstance(k, Mapping) and "field" in k):
            raise self.fail(path, "fields only")
        return self.expression(k, path)

    def order_key(self, k: Any, path: str, aliases: Mapping[str, Any]) -> dict[str, Any]:
        if not isinstance(k, Mapping):
            raise self.fail(path, "not an order key")
        desc = k.get("desc", False)
        e = self.expression({n: v for n, v in k.items() if n != "desc"}, path)
        e = _substituted(e, aliases)
        if not self.j and "field" not in e and "aggregate" not in e and "binary" not in e:
            raise self.fail(path, "fields only")
        return {**e, **({"desc": True} if desc else {})}


def _holds(x: Any, key: str) -> bool:
    if isinstance(x, Mapping):
        return key in x or any(_holds(v, key) for v in x.values())
    return isinstance(x, list) and any(_holds(v, key) for v in x)


def _substituted(x: Any, aliases: Mapping[str, Any]) -> Any:
    """An unqualified field that is a column's alias becomes that column's expression, but not inside aggregates."""
    if isinstance(x, Mapping):
        if "aggregate" in x or "query" in x:
            return dict(x)
        if "field" in x and not x.get("source") and x["field"] in aliases and aliases[x["field"]] != x:
            return dict(aliases[x["field"]])
        return {k: _substituted(v, aliases) for k, v in x.items()}
    return [_substituted(v, aliases) for v in x] if isinstance(x, list) else x


def canonical(x: Any) -> Any:
    """Mappings with their keys in the grammar's order, empty parts left out."""
    order = {k: i for i, k in enumerate(["type", "as", "database", "schema", "name", "alias", "query", "op", "function", "field", "source", "left", "right", *QUERY_KEYS, "scan", "joins", "on", "hints"])}
    if isinstance(x, Mapping):
        return {k: canonical(v) for k, v in sorted(x.items(), key=lambda p: (order.get(p[0], 99), p[0])) if v is not None or k == "value"}
    return [canonical(v) for v in x] if isinstance(x, list) else x


def to_json(q: Query) -> str:
    return json.dumps(q.to_dict(), ensure_ascii=False, separators=(",", ":"))
