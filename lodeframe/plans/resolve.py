"""Resolves trees of the text language against a catalog to recursive (R) documents.

Parameters become bound literals, definitions derived tables, imports the caller's pinned texts; joins without
conditions take a declared relationship; a missing SELECT takes the default projection; operations that have no
exact meaning on their types are refused.
"""

from __future__ import annotations

import datetime
import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

from lodeframe.errors import NotFoundError, QueryError
from lodeframe.plans.document import Query, parse
from lodeframe.plans.text import MAX_IMPORTS, Document, TextError, parse_text, sources
from lodeframe.sources.catalog import Catalog

#: Names that parameters may not take.
RESERVED = {"now", "today", "user", "project"}
_DECIMAL = re.compile(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)\Z")
_INSTANT = re.compile(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d{1,9})?(Z|[+-]\d\d:\d\d)\Z")
_SEGMENT = re.compile(r"[^/\\{}\s]+\Z")


@dataclass
class Context:
    """What a text is resolved with. imports: project-relative path to text, each pinned once."""

    bindings: Mapping[str, Any] = field(default_factory=dict)
    variables: Mapping[str, Any] = field(default_factory=dict)
    imports: Mapping[str, str] = field(default_factory=dict)
    importing_path: str = ""


@dataclass
class Resolved:
    query: Query
    columns: list[dict[str, Any]]
    receipts: dict[str, Any]


def fail(code: str, message: str) -> TextError:
    return TextError(code, message, (0, 0))


def check_value(kind: str, value: Any) -> bool:
    """Whether a value binds to a parameter of a type; null binds to any."""
    if value is None:
        return True
    if kind == "integer":
        return isinstance(value, int) and not isinstance(value, bool) and abs(value) < 1 << 53
    if kind == "boolean":
        return isinstance(value, bool)
    if not isinstance(value, str):
        return False
    if kind == "decimal":
        return len(value) <= 64 and bool(_DECIMAL.match(value))
    if kind == "date":
        try:
            return datetime.date.fromisoformat(value).isoformat() == value
        except ValueError:
            return False
    if kind in ("datetime", "timestamp"):
        if not _INSTANT.match(value):
            return False
        try:
            datetime.datetime.fromisoformat(value.replace("Z", "+00:00"))
        except ValueError:
            return False
    return True


class Resolver:
    def __init__(self, catalog: Catalog, context: Context):
        self.catalog, self.context = catalog, context
        self.expansions = 0
        self.stack: list[str] = []
        self.receipts: dict[str, Any] = {"imports": [], "relationships": []}
        self.merged: dict[tuple[Any, ...], list[tuple[str, str]]] = {}  # (aliases, alias, field) to all fields a merged key stands for

    # -- parameters --------------------------------------------------------------------------------------

    def bound(self, declared: list[dict[str, Any]], given: Mapping[str, Any]) -> dict[str, tuple[str, Any]]:
        out = {}
        for p in declared:
            if p["name"].lower() in RESERVED:
                raise fail("reserved_parameter", f"@{p['name']} is reserved")
            if "default" in p and not check_value(p["type"], p["default"]):
                raise fail("invalid_parameter_default", f"@{p['name']} is no {p['type']}")
            if p["name"] in given:
                value = given[p["name"]]
                if not check_value(p["type"], value) or (value is None and p.get("required")):
                    raise fail("invalid_binding", f"@{p['name']} is no {p['type']}")
            elif p.get("required"):
                raise fail("missing_required_binding", f"@{p['name']} is required")
            else:
                value = p.get("default")
            out[p["name"]] = (p["type"], value)
        for name in given:
            if name not in out:
                raise fail("unknown_binding", f"@{name} is not declared")
        return out

    # -- documents ---------------------------------------------------------------------------------------

    def document(self, doc: Document, given: Mapping[str, Any], path: str = "") -> dict[str, Any]:
        if doc.tree is None:
            d = doc.diagnostics[0]
            raise TextError(d["code"], d["message"], d["span"])
        params = self.bound(doc.tree.get("parameters", []), given)
        names = [d["name"] for d in doc.tree.get("definitions", ())]
        if len(set(names)) < len(names):
            raise fail("duplicate_definition", "a name is defined twice")
        known = self.definitions(doc.tree.get("definitions", ()), {}, params, path)
        return self.query(doc.tree["query"], known, params, path, [])

    def definitions(self, definitions: Any, known: Mapping[str, Any], params: Mapping[str, Any], path: str) -> dict[str, Any]:
        out, later = dict(known), [d["name"] for d in definitions]
        for d in definitions:
            own = later.pop(0)
            if "import" in d:
                out[own] = self.imported(d, params, path)
                continue
            for s in sources(d["query"]):
                if s.get("name") == own and own not in known:
                    raise fail("recursive_cte", f"{own} reads itself")
                if s.get("name") in later and s["name"] not in known:
                    raise fail("forward_cte_reference", f"{s['name']} is defined later")
            out[own] = self.query(d["query"], out, params, path, [])
        return out

    def imported(self, d: Mapping[str, Any], params: Mapping[str, Any], path: str) -> dict[str, Any]:
        target = d["import"]
        if not target.startswith("./") or ".." in target.split("/") or "\\" in target:
            raise fail("import_outside_project", f"{target} is not inside the project")
        name = "/".join([*path.split("/")[:-1], target[2:]]) if "/" in path else target[2:]
        if name in self.stack:
            raise fail("import_cycle", f"{name} imports itself")
        if name not in self.context.imports:
            raise fail("unpinned_import", f"{name} is not among the imports")
        self.expansions += 1
        if self.expansions > MAX_IMPORTS:
            raise fail("import_expansion_limit", f"more than {MAX_IMPORTS} imports")
        doc = parse_text(self.context.imports[name])
        if doc.tree is None:
            raise fail("invalid_import", f"{name}: {doc.diagnostics[0]['message']}")
        declared = {p["name"]: p for p in doc.tree.get("parameters", ())}
        given = {}
        for parameter, e in (d.get("using") or {}).items():
            if parameter not in declared:
                raise fail("unknown_import_parameter", f"@{parameter} is not a parameter of {name}")
            if "value" in e:
                given[parameter] = e["value"]
            elif "param" in e:
                if e["param"] not in params:
                    raise fail("undeclared_parameter", f"@{e['param']}")
                given[parameter] = params[e["param"]][1]
            else:
                raise fail("unsupported_import_mapping_expression", "only literals and parameters")
            if not check_value(declared[parameter]["type"], given[parameter]):
                raise fail("invalid_import_mapping", f"@{parameter} is no {declared[parameter]['type']}")
        for p in declared.values():
            if p.get("required") and p["name"] not in given:
                raise fail("missing_import_mapping", f"@{p['name']} of {name}")
        self.stack.append(name)
        out = self.document(doc, given, name)
        self.stack.pop()
        self.receipts["imports"].append(name)
        return out

    # -- sources -----------------------------------------------------------------------------------------

    def table(self, s: Mapping[str, Any], known: Mapping[str, Any], params: Mapping[str, Any]) -> tuple[dict[str, Any], list[tuple[str, str]]]:
        """The relation of a source and its fields (name, type)."""
        if "path" not in s and not s.get("schema") and not s.get("database") and s["name"] in known:
            body = known[s["name"]]
            alias = s.get("alias") or s["name"]
            return {"query": {**body, "as": alias}}, [(n, "any") for n in output_names(body, self)]
        r: dict[str, Any] = {k: s[k] for k in ("database", "schema", "name") if s.get(k)}
        if "path" in s:
            parts = []
            for x in s["path"]:
                if isinstance(x, str):
                    parts.append(x)
                    continue
                name = x["variable"]
                if name not in self.context.variables and name not in params:
                    raise fail("undeclared_parameter", f"{{{name}}}")
                value = self.context.variables[name] if name in self.context.variables else params[name][1]
                if not isinstance(value, (str, int)) or isinstance(value, bool) or not _SEGMENT.match(str(value)) or str(value) in (".", ".."):
                    raise fail("invalid_path_value", f"{{{name}}} is no path segment")
                parts.append(str(value))
            r["name"] = "/".join(parts)
        r["alias"] = s.get("alias") or r["name"].split("/")[-1]
        try:
            table = self.catalog.find(r)
        except NotFoundError as e:
            raise fail("unauthorized_source", str(e)) from e
        df = table.open()
        return r, [(f.name, table.types.get(f.name, f.dataType.simpleString())) for f in df.schema.fields]

    # -- queries -----------------------------------------------------------------------------------------

    def query(self, q: Mapping[str, Any], known: Mapping[str, Any], params: Mapping[str, Any], path: str, outer: list[dict[str, dict[str, str]]]) -> dict[str, Any]:
        if q.get("definitions"):
            known = self.definitions(q["definitions"], known, params, path)
        root, fields = self.table(q["from"], known, params)
        alias_of = lambda r: r["query"]["as"] if "query" in r else r["alias"]
        scope: dict[str, dict[str, str]] = {alias_of(root): dict(fields)}
        tables = {alias_of(root): root}
        merged: list[tuple[str, str, str, str]] = []
        joins = []
        for j in q.get("joins") or ():
            r, fields = self.table(j["source"], known, params)
            alias = alias_of(r)
            if alias in scope:
                raise fail("invalid_join", f"duplicate alias {alias}")
            before = dict(scope)
            scope[alias] = dict(fields)
            tables[alias] = r
            if "on" in j:
                on = self.on(j["on"], scope)
            else:
                on, pairs = self.relationship(alias, before, tables, scope, j.get("shorthand"))
                if j["type"] == "inner":
                    merged += pairs
            joins.append({"type": j["type"], "from": r, "on": on})
        if joins:
            root = {**root, "joins": joins}
        levels = [scope, *outer]
        out: dict[str, Any] = {"from": root}
        expression = lambda e: self.expression(e, params)
        if "where" in q:
            out["where"] = self.condition(q["where"], params, levels)
        if "group by" in q:
            out["groupBy"] = [expression(e) for e in q["group by"]]
        if "having" in q:
            out["having"] = self.condition(q["having"], params, levels, having=True)
        if "order by" in q:
            aliases = {i["as"]: i for i in q.get("select") or () if i.get("as")}
            out["orderBy"] = []
            for k in q["order by"]:
                e = {n: v for n, v in k.items() if n != "desc"}
                if "field" in e and not e.get("source") and e["field"] in aliases:
                    e = {n: v for n, v in aliases[e["field"]].items() if n != "as"}
                elif "field" not in e:
                    raise fail("unsupported_order_expression", "order by takes fields")
                out["orderBy"].append({**expression(e), **({"desc": True} if k.get("desc") else {})})
        for n in ("limit", "offset"):
            if n in q:
                value = q[n] if isinstance(q[n], int) else params.get(q[n]["param"], (None, None))[1]
                if not isinstance(value, int):
                    raise fail(f"invalid_{n}", "a whole number")
                out[n] = value
        if "select" in q:
            out["columns"] = []
            for n, i in enumerate(q["select"]):
                if "query" in i:
                    body = self.query(i["query"], known, params, path, levels)
                    if len(body.get("columns") or ()) != 1:
                        raise fail("scalar_column_count", f"columns[{n}] has one column")
                    out["columns"].append({"query": {**body, "as": i["as"]}})
                    continue
                e = expression({k: v for k, v in i.items() if k != "as"})
                if e.get("star"):
                    raise fail("unsupported_projection", "* selects nothing by itself")
                if "field" in e:
                    self.authorized(e, levels)
                name = i.get("as") or (None if "binary" in e or "value" in e else e.get("field"))
                if name is None and "aggregate" not in e:
                    raise fail("invalid_projection", "the column needs an alias")
                out["columns"].append({**e, **({"as": name} if name else {})})
            names = [c.get("as") or (c["query"]["as"] if "query" in c else c["aggregate"]["function"]) for c in out["columns"]]
            if len(set(names)) < len(names):
                raise fail("duplicate_output_name", "two columns have one name")
        elif "groupBy" not in out:
            out["columns"] = default_projection(scope, merged, self.merged)
        self.safe(out, levels)
        return out

    def authorized(self, e: Mapping[str, Any], levels: list[dict[str, dict[str, str]]]) -> str:
        """The type of a field, found from the innermost level out."""
        for scope in levels:
            if e.get("source"):
                if e["source"] in scope:
                    if e["field"] not in scope[e["source"]]:
                        raise fail("unauthorized_field", f"{e['source']}.{e['field']}")
                    return scope[e["source"]][e["field"]]
                continue
            owners = [a for a, f in scope.items() if e["field"] in f]
            if len(owners) > 1:
                raise fail("ambiguous_field", e["field"])
            if owners:
                return scope[owners[0]][e["field"]]
        raise fail("unauthorized_field", f"{e.get('source', '')}.{e['field']}".lstrip("."))

    def on(self, c: Mapping[str, Any], scope: Mapping[str, Any]) -> list[dict[str, Any]]:
        out = []
        for p in c.get("and", [c]):
            if p.get("op") != "==" or not all("field" in p[s] for s in ("left", "right")):
                raise fail("invalid_join_condition", "only equal fields")
            sides = {}
            for s in ("left", "right"):
                e = dict(p[s])
                self.authorized(e, [dict(scope)])
                if not e.get("source"):
                    e["source"] = next(a for a, f in scope.items() if e["field"] in f)
                sides[s] = e
            out.append({"left": sides["left"], "op": "==", "right": sides["right"]})
        return out

    def relationship(self, alias: str, before: Mapping[str, Any], tables: Mapping[str, Any], scope: Mapping[str, Any], shorthand: str | None) -> tuple[list[dict[str, Any]], list[tuple[str, str, str, str]]]:
        """ON of the one relationship between a new source and an earlier one."""
        name = tables[alias].get("name")
        found = []
        for r in self.catalog.relationships:
            for other in before:
                theirs = tables[other].get("name")
                for left, right, pairs in ((r.left, r.right, r.pairs), (r.right, r.left, tuple((b, a) for a, b in r.pairs))):
                    if (left, right) == (theirs, name) and all(a in scope[other] and b in scope[alias] for a, b in pairs):
                        if shorthand is not None and shorthand not in {x for p in pairs for x in p}:
                            continue
                        if tables[other].get("database") != tables[alias].get("database"):
                            raise fail("cross_database_relationship", r.id)
                        if r.exact_types and any(scope[other][a] != scope[alias][b] for a, b in pairs):
                            continue
                        found.append((r.id, other, pairs))
        if shorthand is not None and not found:
            owners = [a for a in before if shorthand in before[a]]
            if len(owners) == 1 and shorthand in scope[alias]:
                found.append((f"on {shorthand}", owners[0], ((shorthand, shorthand),)))
        if not found:
            raise fail("relationship_not_found" if shorthand else "relationship_required", f"no relationship joins {alias}")
        if len(found) > 1:
            raise fail("ambiguous_relationship", ", ".join(f[0] for f in found))
        identity, other, pairs = found[0]
        self.receipts["relationships"].append(identity)
        on = [{"left": {"field": a, "source": other}, "op": "==", "right": {"field": b, "source": alias}} for a, b in pairs]
        return on, [(other, a, alias, b) for a, b in pairs]

    def expression(self, e: Mapping[str, Any], params: Mapping[str, Any]) -> dict[str, Any]:
        if "param" in e:
            if e["param"] not in params:
                raise fail("undeclared_parameter", f"@{e['param']}")
            return {"value": params[e["param"]][1]}
        if "binary" in e:
            b = e["binary"]
            for s in ("left", "right"):
                if "param" in b[s] and params.get(b[s]["param"], ("",))[0] == "decimal":
                    raise fail("unsupported_decimal_semantics", "no arithmetic on decimals")
            return {"binary": {"op": b["op"], "left": self.expression(b["left"], params), "right": self.expression(b["right"], params)}}
        if "aggregate" in e:
            a = e["aggregate"]
            if len(a["args"]) != 1:
                raise fail("invalid_expression", "an aggregate has one argument")
            return {"aggregate": {"function": a["function"], "args": [self.expression(a["args"][0], params)]}}
        if "call" in e:
            raise fail("unsupported_function", e["call"]["name"])
        return {k: v for k, v in e.items() if k != "as"}

    def condition(self, c: Mapping[str, Any], params: Mapping[str, Any], levels: list[Any], having: bool = False) -> dict[str, Any]:
        for w in ("and", "or"):
            if w in c:
                return {w: [self.condition(x, params, levels, having) for x in c[w]]}
        for w in ("isNull", "isNotNull"):
            if w in c:
                return {w: self.expression(c[w], params)}
        if "op" not in c or c["op"] == "<>":
            raise fail("invalid_condition", "not a comparison")
        kinds = [params[c[s]["param"]][0] if "param" in c[s] and c[s]["param"] in params else "" for s in ("left", "right")]
        for kind in kinds:
            if kind == "decimal":
                raise fail("unsupported_decimal_semantics", "decimals do not compare")
            if kind in ("datetime", "timestamp"):
                raise fail("unsupported_temporal_semantics", "instants do not compare")
        return {"op": c["op"], "left": self.expression(c["left"], params), "right": self.expression(c["right"], params)}

    def safe(self, q: Mapping[str, Any], levels: list[Any]) -> None:
        """Declared decimals and instants take no part in arithmetic or comparisons."""

        def kind(e: Mapping[str, Any]) -> str:
            return self.authorized(e, levels) if "field" in e else ""

        def walk(x: Any) -> None:
            if isinstance(x, list):
                for v in x:
                    walk(v)
            elif isinstance(x, Mapping):
                if "query" in x and "from" not in x:
                    return
                if "left" in x and "right" in x:
                    for s in ("left", "right"):
                        declared = kind(x[s])
                        if declared == "decimal":
                            raise fail("unsupported_decimal_semantics", f"{x[s]['field']} is a decimal")
                        if declared in ("datetime",):
                            raise fail("unsupported_temporal_semantics", f"{x[s]['field']} is an instant")
                if "field" in x:
                    kind(x)
                for k, v in x.items():
                    if k not in ("from", "query"):
                        walk(v)

        for part in ("where", "groupBy", "having", "orderBy"):
            walk(q.get(part))
        walk([c for c in q.get("columns") or () if "query" not in c])


def default_projection(scope: Mapping[str, Mapping[str, str]], merged: list[tuple[str, str, str, str]], members: dict[tuple[Any, ...], list[tuple[str, str]]]) -> list[dict[str, Any]]:
    """All fields in order; the keys of a complete inner relationship show once (members takes what they stand for);
    names that clash become source_name, then source_name_2 and so on."""
    root: dict[tuple[str, str], tuple[str, str]] = {}

    def find(x: tuple[str, str]) -> tuple[str, str]:
        while x in root:
            x = root[x]
        return x

    for a, f, b, g in merged:
        x, y = find((a, f)), find((b, g))
        if x != y:
            root[y] = x
    every = [(a, f) for a, fields in scope.items() for f in fields]
    shown = [x for x in every if find(x) == x]
    for x in every:
        members.setdefault((tuple(scope), *find(x)), []).append(x)
    names: set[str] = set()
    out = []
    for a, f in shown:
        name = f if sum(1 for _, g in shown if g == f) == 1 else f"{a}_{f}"
        n, base = 2, name
        while name in names:
            name, n = f"{base}_{n}", n + 1
        names.add(name)
        out.append({"field": f, "source": a, "as": name})
    return out


def output_names(body: Mapping[str, Any], resolver: Resolver) -> list[str]:
    if body.get("columns"):
        return [c.get("as") or (c["query"]["as"] if "query" in c else c.get("field") or c["aggregate"]["function"]) for c in body["columns"]]
    out: list[str] = []

    def walk(r: Mapping[str, Any]) -> None:
        names = output_names(r["query"], resolver) if "query" in r else resolver.catalog.fields(r)
        out.extend(n for n in names if n not in out)
        for j in r.get("joins") or ():
            walk(j["from"])

    walk(body["from"])
    return out


def lineage(body: Mapping[str, Any], resolver: Resolver, outer: Mapping[str, Mapping[str, list[tuple[str, str]]]] | None = None) -> dict[str, list[tuple[str, str]]]:
    """For each output column the (alias, field) of the stored fields it is made from, through derived tables and
    scalar queries; none for counts and literals."""
    own: dict[str, dict[str, list[tuple[str, str]]]] = {}

    def add(r: Mapping[str, Any]) -> None:
        alias = r.get("alias") or r.get("as") or (r["query"].get("as") if "query" in r else r["name"])
        own[alias] = lineage(r["query"], resolver, {**(outer or {}), **own}) if "query" in r else {f: [(alias, f)] for f in resolver.catalog.fields(r)}
        for j in r.get("joins") or ():
            add(j["from"])

    def of(e: Mapping[str, Any]) -> list[tuple[str, str]]:
        if "field" in e:
            for level in (own, outer or {}):
                for alias, fields in level.items():
                    if e.get("source", alias) == alias and e["field"] in fields:
                        return fields[e["field"]]
            return []
        if "aggregate" in e:
            a = e["aggregate"]
            return [] if a["function"].lower() == "count" else [x for v in (a.get("args") or ())[:1] for x in of(v)]
        if "binary" in e:
            return list(dict.fromkeys(of(e["binary"]["left"]) + of(e["binary"]["right"])))
        return next(iter(lineage(e["query"], resolver, {**(outer or {}), **own}).values())) if "query" in e else []

    add(body["from"])
    names = output_names(body, resolver)
    if not body.get("columns"):
        return {n: of({"field": n}) for n in names}
    out = {}
    for name, c in zip(names, body["columns"], strict=True):
        kept = resolver.merged.get((tuple(own), c.get("source"), c.get("field")), [])
        out[name] = list(dict.fromkeys(x for a, f in kept for x in own[a][f])) if len(kept) > 1 else of(c)
    return out


def resolve_text(catalog: Catalog, source: str | Document, context: Context | None = None, **bindings: Any) -> Resolved:
    """The R query of a text, its columns with types and lineage, and receipts of what it was resolved from."""
    from lodeframe.plans.compile import Compiler

    context = context or Context(bindings=bindings)
    doc = source if isinstance(source, Document) else parse_text(source)
    resolver = Resolver(catalog, context)
    try:
        body = resolver.document(doc, context.bindings, context.importing_path)
        q = parse(body, dialect="R")
        _, columns, _ = Compiler(catalog, "R").query(q.body, None, "")
    except QueryError as e:
        raise fail(e.code, str(e)) from e
    made = lineage(q.body, resolver)
    shown = [{"name": n, "type": t or k, "lineage": [{"source": a, "field": f} for a, f in made.get(n, ())] or None} for n, k, t in columns]
    return Resolved(q, shown, {"version": 1, **resolver.receipts})


def text_frame(catalog: Catalog, source: str | Document, context: Context | None = None, **bindings: Any) -> DataFrame:
    """The lazy DataFrame of a text."""
    from lodeframe.plans.run import to_frame

    return to_frame(catalog, resolve_text(catalog, source, context, **bindings).query)
