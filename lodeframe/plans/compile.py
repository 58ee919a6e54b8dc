"""Compiles query documents to Spark SQL over the catalog's DataFrames; Catalyst plans and runs them.

A document is a plain dict in the wire grammar (see document.py), in one of two dialects: J (flat documents of
joined relations) and R (recursive documents with subqueries). They differ in null, zero and first/last rules; the
differences are marked with `self.j`. Every literal is a bound parameter, every identifier is quoted.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeframe.errors import QueryError, UnsupportedError
from lodeframe.operators.lookup import BROADCAST_BYTES, estimated_bytes
from lodeframe.sources.catalog import RANKS, Catalog, class_of

INFINITY = "CAST('Infinity' AS DOUBLE)"
#: Join keys are equalities, so a nested loop needs no product of the tables: sorted by key, it runs within each key, without a hash table.
HINTS = {"hash": "SHUFFLE_HASH", "merge": "MERGE", "lookup": "BROADCAST", "batchedLookup": "BROADCAST", "nestedLoop": "MERGE"}


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def placed(df: DataFrame) -> DataFrame:
    """df with the place of each row, _ord, in its file where it comes straight from files: unlike a number given on
    the way this lets filters reach the scan, and does not change with the splits."""
    try:
        return df.withColumn("_ord", F.struct("_metadata.file_path", "_metadata.row_index"))
    except AnalysisException:
        return df


@dataclass
class Term:
    """An expression: SQL, its class, and its Spark type's name where known."""

    sql: str
    kind: str
    type: str = ""


@dataclass
class Relation:
    alias: str
    fields: dict[str, Term]
    optional: bool = False
    lateral: set[str] = field(default_factory=set)  # aliases before it that a derived table refers to


@dataclass
class Later:
    """A LEFT join that reaches out of its bracket, to be made after the join above."""

    sql: str
    aliases: list[str]
    on: str
    names: set[str]


@dataclass
class Scope:
    """Aliases of one query level; outer levels hang on parent. lookup: takes a field from a grouped query."""

    relations: dict[str, Relation] = field(default_factory=dict)
    parent: Scope | None = None
    lookup: Callable[[str, str], Term] | None = None
    equal: list[tuple[str, str, str, str]] = field(default_factory=list)  # (outer alias, field, own alias, field)
    carried: dict[tuple[str, str], str] = field(default_factory=dict)
    carries: list[tuple[str, str, str, Scope]] = field(default_factory=list)
    source: str = ""
    beside: bool = False  # relations before a derived table in the same FROM: no level of its own
    reached: set[tuple[str, str]] = field(default_factory=set)  # fields of the level above that were named
    joins_outer: bool = False  # such fields come from the join with their distinct values

    def term(self, alias: str, name: str) -> Term:
        return self.lookup(alias, name) if self.lookup else self.relations[alias].fields[name]


class Compiler:
    def __init__(self, catalog: Catalog, dialect: str = "J"):
        self.catalog, self.j = catalog, dialect == "J"
        self.frames: dict[str, DataFrame] = {}
        self.args: dict[str, Any] = {}
        self.numbers = itertools.count()
        self.by_values = False  # a derived table evaluated for each row beside it cannot number rows: its ties order by value

    # -- parts -------------------------------------------------------------------------------------------

    def literal(self, value: Any) -> Term:
        if value is None:
            return Term("NULL", "null")
        name = f"p{next(self.numbers)}"
        self.args[name] = value
        if isinstance(value, bool):
            return Term(f":{name}", "bool", "boolean")
        if isinstance(value, (int, float)):
            return Term(f":{name}", "number", "bigint" if isinstance(value, int) else "double")
        return Term(f":{name}", "string", "string")

    def raised(self, message: str, kind: str = "BOOLEAN") -> str:
        return f"CAST(raise_error({self.literal(message).sql}) AS {kind})"

    def finite(self, sql: str, message: str) -> str:
        bad = f"isnan({sql}) OR abs({sql}) = {INFINITY}"
        return f"CASE WHEN {bad} THEN {self.raised(message, 'DOUBLE')} ELSE {sql} END"

    def resolve(self, scope: Scope, ref: Mapping[str, Any], path: str) -> Term:
        name, source = ref["field"], ref.get("source")
        level, depth = scope, 0
        while level is not None:
            if source is not None:
                owners = [source] if source in level.relations else []
                if owners and name not in level.relations[source].fields:
                    raise QueryError("join_field" if self.j else "scope", path, f"unknown field {source}.{name}")
            else:
                owners = [a for a, r in level.relations.items() if name in r.fields]
            if len(owners) > 1:
                raise QueryError("join_scope" if self.j else "scope", path, f"ambiguous field {name}")
            if owners and depth == 1 and level is scope.parent:
                scope.reached.add((owners[0], name))
                term = level.term(owners[0], name)
                return Term(self.from_outer(scope, owners[0], name, term.sql), term.kind, term.type) if scope.joins_outer else term
            if owners:
                return level.term(owners[0], name) if depth < 2 else self.carry(scope, level, owners[0], name, depth)
            level, depth = level.parent, depth + (not level.beside)
        raise QueryError("join_field" if self.j and source is None else "join_scope" if self.j else "scope", path, f"unknown field {f'{source}.' if source else ''}{name}")

    def carry(self, scope: Scope, home: Scope, alias: str, name: str, depth: int) -> Term:
        """A field from two or more levels out: Spark sees one level, so each level between hands it on, as a field
        of its own that is equal to it or by joining the distinct outer values."""
        levels = [scope]
        while levels[-1].parent is not home:
            levels.append(levels[-1].parent)
        levels = [x for x in levels if not x.beside]
        term = home.term(alias, name)
        key = (alias, name)
        for level in reversed(levels[1:]):
            same = next(((a, f) for o, n, a, f in level.equal if (o, n) == key), None)
            if same:
                term = level.relations[same[0]].fields[same[1]]
                key = same
            else:
                term = Term(self.from_outer(level, *key, term.sql), term.kind, term.type)
                key = ("_outer", level.carried[key])
        return term

    def from_outer(self, scope: Scope, alias: str, name: str, sql: str) -> str:
        """A field of the level above as a column of the join with its distinct values."""
        key = (alias, name)
        if key not in scope.carried:
            scope.carried[key] = f"_o{len(scope.carried)}"
            scope.carries.append((alias, name, sql, scope.parent))
        return f"_outer.{scope.carried[key]}"

    def wants_outer(self, scope: Scope) -> bool:
        """Whether a grouped or limited query is tied to the level above by an equality and by more. Spark takes the
        equality out of it and leaves the distinct values of the other fields, each of which then meets every row; where
        all the fields are joined at once, by the equality, rows only meet what they belong to."""
        home, equal = scope.parent, {(o, n) for o, n, _, _ in scope.equal}
        if home is None or not home.source or home.parent is not None or (home.lookup and not home.beside):
            return False
        # a source that numbers rows on the way is no part of a correlated query; what can't be grouped has no distinct values
        plain = all(home.relations[a].fields[n].kind != "other" for a, n in scope.reached)
        return plain and "monotonically_increasing_id()" not in home.source and bool(scope.reached & equal) and bool(scope.reached - equal)

    # -- expressions -------------------------------------------------------------------------------------

    def expression(self, scope: Scope, e: Mapping[str, Any], path: str, grouped: Grouping | None = None) -> Term:
        if grouped is not None:
            found = grouped.take(self, e, path)
            if found is not None:
                return found
        if "field" in e:
            return self.resolve(scope, e, path)
        if "value" in e:
            return self.literal(e["value"])
        if "values" in e:
            return Term("", "list")
        if "param" in e:
            return Term(self.raised(f"join_plan at {path}: unsupported expression param", "DOUBLE"), "number", "double")
        if "binary" in e:
            b = e["binary"]
            left = self.expression(scope, b["left"], f"{path}.binary.left", grouped)
            right = self.expression(scope, b["right"], f"{path}.binary.right", grouped)
            return self.arithmetic(b["op"], left, right)
        if "aggregate" in e:
            return Term(self.raised(f"join_aggregate at {path}: aggregate outside a grouped query", "DOUBLE"), "number", "double")
        if "query" in e:
            sql, columns, _ = self.query(e["query"], scope, f"{path}.query")
            if len(columns) != 1:
                raise QueryError("shape", f"{path}.query.columns", "a scalar query has exactly one column")
            return Term(f"({sql})", columns[0][1], columns[0][2])
        raise QueryError("join_shape" if self.j else "shape", path, "unknown expression")

    def number(self, t: Term) -> str:
        if t.kind == "mixed":
            return f"CASE WHEN {t.sql}.r = 2 THEN {t.sql}.n END"
        return t.sql if t.kind == "number" else "CAST(NULL AS DOUBLE)"

    def arithmetic(self, op: str, a: Term, b: Term) -> Term:
        x, y = f"CAST({self.number(a)} AS DOUBLE)", f"CAST({self.number(b)} AS DOUBLE)"
        if op == "/":
            sql = f"try_divide({x}, {y})" if self.j else f"CASE WHEN {y} = 0 THEN {x} * {INFINITY} ELSE {x} / {y} END"
        else:
            sql = f"({x} {op} {y})"
        return Term(sql, "number", "double")

    def alike(self, a: Term, b: Term) -> tuple[str, str] | None:
        """SQL of both sides where they compare natively, or None where their classes differ."""
        if a.kind == b.kind:
            return a.sql, b.sql
        if {a.kind, b.kind} == {"time", "string"}:
            cast = lambda t: f"CAST({t.sql} AS TIMESTAMP)" if t.kind == "string" else t.sql
            return cast(a), cast(b)
        if "mixed" in (a.kind, b.kind) and {a.kind, b.kind} <= {"mixed", "bool", "number", "string"}:
            return self.lifted(a), self.lifted(b)
        return None

    def lifted(self, t: Term) -> str:
        if t.kind == "mixed":
            return t.sql
        number = f"CAST({t.sql} AS DOUBLE)" if t.kind in ("bool", "number") else "CAST(NULL AS DOUBLE)"
        text = t.sql if t.kind == "string" else "CAST(NULL AS STRING)"
        return f"CASE WHEN {t.sql} IS NOT NULL THEN named_struct('r', CAST({RANKS[t.kind]} AS TINYINT), 'n', {number}, 's', {text}) END"

    def compare(self, op: str, a: Term, b: Term, two_valued: bool = False) -> str:
        """J's WHERE has a two-valued !=; J's HAVING (two_valued) has two-valued comparisons throughout."""
        if op == "eq":
            op = "=="
        sides = self.alike(a, b)
        nulls = f"({a.sql} IS NULL OR {b.sql} IS NULL)"
        if "null" in (a.kind, b.kind):
            if op in ("==", "!=") and (two_valued or (self.j and op == "!=")):
                both = f"({a.sql} IS NULL AND {b.sql} IS NULL)"
                return both if op == "==" else f"(NOT {both})"
            return "false" if two_valued else "CAST(NULL AS BOOLEAN)"
        if op in ("==", "!="):
            null_is_value = two_valued or (self.j and op == "!=")
            if null_is_value:
                same = f"({sides[0]} <=> {sides[1]})" if sides else f"({a.sql} IS NULL AND {b.sql} IS NULL)"
                return same if op == "==" else f"(NOT {same})"
            if sides:
                return f"({sides[0]} {'=' if op == '==' else '<>'} {sides[1]})"
            return f"CASE WHEN {nulls} THEN NULL ELSE {'false' if op == '==' else 'true'} END"
        if sides:
            sql = f"({sides[0]} {op} {sides[1]})"
        else:
            x, y = RANKS.get(a.kind, 4), RANKS.get(b.kind, 4)
            sql = f"CASE WHEN {nulls} THEN NULL ELSE {str({'<': x < y, '<=': x <= y, '>': x > y, '>=': x >= y}[op]).lower()} END"
        return f"coalesce({sql}, false)" if two_valued else sql

    def member(self, a: Term, values: list[Any], negated: bool) -> str:
        if not values:
            return "true" if negated else "false"
        items = [self.literal(v) for v in values if v is not None]
        fitting = [s for s in (self.alike(a, t) for t in items) if s]
        listed = ", ".join([s[1] for s in fitting] + ["NULL"] * (None in values))
        if a.kind == "null":
            return "CAST(NULL AS BOOLEAN)"
        sql = f"({fitting[0][0] if fitting else a.sql} IN ({listed}))" if listed else f"CASE WHEN {a.sql} IS NULL THEN NULL ELSE false END"
        return f"(NOT {sql})" if negated else sql

    def member_query(self, scope: Scope, a: Term, query: Mapping[str, Any], negated: bool, path: str, nested: bool) -> str:
        sql, columns, _ = self.query(query, scope, path)
        if len(columns) != 1:
            raise QueryError("shape", path, "a membership query has one column")
        name, kind, _ = columns[0]
        value = Term(f"_m.{quoted(name)}", kind)
        sides = self.alike(a, value)
        if sides and not nested:
            return f"({sides[0]} {'NOT ' * negated}IN (SELECT {sides[1]} FROM ({sql}) AS _m))"
        # under OR, and between classes: spelled out, as Spark takes null-aware anti joins at the top only
        rows = f"FROM ({sql}) AS _m"
        hit = f"EXISTS (SELECT 1 {rows} WHERE {sides[0]} = {sides[1]})" if sides else "false"
        return f"CASE WHEN NOT EXISTS (SELECT 1 {rows}) THEN {str(negated).lower()} WHEN {a.sql} IS NULL THEN NULL WHEN {hit} THEN {str(not negated).lower()} WHEN EXISTS (SELECT 1 {rows} WHERE {value.sql} IS NULL) THEN NULL ELSE {str(negated).lower()} END"

    def condition(self, scope: Scope, c: Mapping[str, Any], path: str, grouped: Grouping | None = None, nested: bool = False) -> str:
        for word in ("and", "or"):
            if word in c:
                parts = [self.condition(scope, x, f"{path}.{word}[{i}]", grouped, nested or word == "or") for i, x in enumerate(c[word])]
                return "(" + f" {word.upper()} ".join(parts) + ")"
        for word, sql in (("isNull", "IS NULL"), ("isNotNull", "IS NOT NULL")):
            if word in c:
                return f"({self.expression(scope, c[word], f'{path}.{word}', grouped).sql} {sql})"
        for word in ("exists", "notExists"):
            if word in c:
                sql = self.query(c[word]["query"], scope, f"{path}.{word}.query", existence=True)[0]
                return f"({'NOT ' * (word == 'notExists')}EXISTS ({sql}))"
        op = c["op"]
        two_valued = self.j and grouped is not None
        left = self.expression(scope, c["left"], f"{path}.left", grouped)
        if op in ("In", "NotIn", "in", "not-in"):
            negated = op in ("NotIn", "not-in")
            if two_valued:
                return self.raised(f"join_aggregate at {path}: unsupported operator {op}")
            right = c["right"]
            if "query" in right:
                return self.member_query(scope, left, right["query"], negated, f"{path}.right.query", nested)
            if "values" in right:
                return self.member(left, right["values"], negated)
            return self.raised(f"join_plan at {path}: {op} needs a list") if self.j else str(negated).lower()
        if op in ("array-contains", "array-contains-any"):
            raise QueryError("join_plan", path, f"unsupported operator {op}")
        return self.compare(op, left, self.expression(scope, c["right"], f"{path}.right", grouped), two_valued)

    # -- relations ---------------------------------------------------------------------------------------

    def leaf(self, r: Mapping[str, Any], scope: Scope, path: str, flags: Flags, guard: bool = False) -> tuple[str, Relation]:
        numbered, lateral = False, set()
        if "query" in r:
            alias = r["query"].get("as") or r.get("as") or r.get("alias")
            siblings = Scope(relations=dict(scope.relations), parent=scope.parent, beside=True, source=scope.source)
            siblings.lookup = lambda a, f: lateral.add(a) or siblings.relations[a].fields[f]
            frame = siblings if scope.relations else scope.parent
            sql, columns, _ = self.query(r["query"], frame, f"{path}.query")
            if lateral and not self.by_values:
                self.by_values = True
                sql, columns, _ = self.query(r["query"], frame, f"{path}.query")
                self.by_values = False
            fields = {n: Term(f"{quoted(alias)}.{quoted(n)}", k, t) for n, k, t in columns}
            inner = sql
        else:
            table = self.catalog.find(r)
            if table.rights is not None and not flags.governed:
                raise UnsupportedError("source-rights-preflight")
            df = table.open()
            scan = r.get("scan")
            if scan:
                keys = [df[k["field"]].desc_nulls_last() if k.get("desc") else df[k["field"]].asc_nulls_first() for k in scan["orderBy"]]
                df = df.orderBy(*keys).limit(scan["limit"])
            alias = r.get("alias") or r.get("as") or r["name"]
            name = f"t{len(self.frames)}"
            fields = {f.name: Term(f"{quoted(alias)}.{quoted(f.name)}", class_of(f.dataType), f.dataType.simpleString()) for f in df.schema.fields}
            if flags.order and not scan:
                df = placed(df)
            numbered = "_ord" in df.columns and "_ord" not in fields
            self.frames[name] = df
            inner = f"SELECT * FROM {{{name}}}"
        number = "struct(*)" if lateral or self.by_values else "monotonically_increasing_id()"
        extra = f", {number} AS _ord" * (flags.order and not numbered) + ", true AS _here" * (flags.presence or guard)
        if extra:
            inner = f"SELECT *{extra} FROM ({inner})"
        if alias in scope.relations:
            raise QueryError("join_scope", path, f"duplicate alias {alias}")
        return f"({inner}) AS {quoted(alias)}", Relation(alias, fields, lateral=lateral)

    def tree(self, r: Mapping[str, Any], scope: Scope, path: str, flags: Flags, optional: bool = False) -> tuple[str, list[str], list[tuple[str, set[str]]], list[Later]]:
        """SQL of a relation with its joins as one bracket, the aliases in it, inner predicates that reach out of it
        with the aliases they name (they belong to the ON of a join above), and LEFT joins that reach out of it (they
        follow the join above: A LEFT (B LEFT C ON p(A, C)) is (A LEFT B) LEFT C ON p(A, C) where B is there)."""
        sql, relation = self.leaf(r, scope, path, flags, guard=path != "from" and bool(r.get("joins")))
        relation.optional = optional
        scope.relations[relation.alias] = relation
        inside, outer, waiting = [relation.alias], [], []
        late: set[str] = set()
        for i, j in enumerate(r.get("joins") or ()):
            here = f"{path}.joins[{i}]"
            scope.source = sql
            left = j.get("type", "inner") == "left"
            right, aliases, reaching, deferred = self.tree(j["from"], scope, f"{here}.from", flags, optional or left)
            known = set(inside) | set(aliases)
            lateral = scope.relations[aliases[0]].lateral
            if lateral:
                if len(aliases) > 1 or not lateral <= known:
                    raise UnsupportedError("a derived table that refers to relations outside its bracket, or has joins of its own")
                right = f"LATERAL {right}"
            on = list(reaching)
            for n, p in enumerate(j.get("on") or ()):
                sides = [p[s] for s in ("left", "right")]
                terms = [self.resolve(scope, x, f"{here}.on[{n}].{s}") for x, s in zip(sides, ("left", "right"), strict=True)]
                on.append((self.key_equal(*terms), {a for x in sides for a, held in scope.relations.items() if x.get("source", a) == a and x["field"] in held.fields}))
            if left and path != "from" and any(not names <= known - late for _, names in on):
                waiting.append(Later(right, aliases, " AND ".join(c for c, _ in on), set().union(*(names for _, names in on))))
                late |= set(aliases)
            else:
                if not left and path != "from":
                    outer += [c for c in on if not c[1] <= known]
                    on = [c for c in on if c[1] <= known]
                if any(names & (late | {a for d in deferred for a in d.aliases}) for _, names in on):
                    raise UnsupportedError("a join by fields of a LEFT join that reaches out of its bracket")
                sql = f"{sql} {'LEFT' if left else 'INNER'} JOIN {right} ON {' AND '.join(c for c, _ in on) or 'true'}"
            inside += aliases
            for d in deferred:
                if left:
                    d.on, d.names = f"{d.on} AND {quoted(aliases[0])}._here", d.names | {aliases[0]}
                if path == "from" or d.names <= set(inside) - late:
                    sql = f"{sql} LEFT JOIN {d.sql} ON {d.on}"
                else:
                    waiting.append(d)
                    late |= set(d.aliases)
            flags.hints += self.hint(j, aliases)
        return (f"({sql})" if len(inside) > 1 and path != "from" else sql), inside, outer, waiting

    def key_equal(self, a: Term, b: Term) -> str:
        """Join keys: null matches nothing, a number matches no string; NaN and objects are errors in J."""
        for t in (a, b):
            if t.kind in ("list", "other") and self.j:
                return self.raised("join_key_type at from: objects and lists are no join keys")
        if t.kind in ("list", "other"):
            return "false"
        sides = self.alike(a, b)
        if sides is None or "null" in (a.kind, b.kind):
            return "false"
        if self.j and a.kind == b.kind:  # the check stands inside the key, so that the join still is one by equality
            message = "join_key_type at from: NaN is no join key"
            x, y = (f"nanvl({t.sql}, {self.raised(message, 'DOUBLE')})" if t.type in ("double", "float") else t.sql for t in (a, b))
            return f"({x} = {y})"
        nan = [f"NOT isnan({t.sql})" for t in (a, b) if t.type in ("double", "float")]
        return "(" + " AND ".join([f"{sides[0]} = {sides[1]}", *nan]) + ")"

    def hint(self, j: Mapping[str, Any], aliases: list[str]) -> list[str]:
        """Spark's hint for the first algorithm that fits: those that copy the right side need it to be small."""
        for name in (j.get("hints") or {}).get("algorithms") or [] if self.j else []:
            if HINTS[name] != "BROADCAST" or ("query" not in j["from"] and estimated_bytes(self.catalog.find(j["from"]).open()) <= BROADCAST_BYTES):
                return [f"{HINTS[name]}({quoted(aliases[0])})"]
        return []

    # -- queries -----------------------------------------------------------------------------------------

    def query(self, q: Mapping[str, Any], outer: Scope | None, path: str, existence: bool = False, governed: bool = False) -> tuple[str, list[tuple[str, str, str]], Scope]:
        """SQL of a query and its columns (name, class, type). existence: only whether rows come matters."""
        scope = Scope(parent=outer)
        found = list(_walk(q))
        aggregates = any("aggregate" in e for e in found)
        grouping = bool(q.get("groupBy")) or aggregates or (self.j and q.get("having") is not None)
        ordered = any(e["aggregate"]["function"].lower() in ("first", "last") for e in found if "aggregate" in e) or (grouping and not self.j)
        # rows that tie keep their order, which shows where LIMIT or OFFSET takes some of them
        ties = bool(q.get("orderBy")) and bool(q.get("limit") or q.get("offset")) and not existence and not self.told_apart(q)
        flags = Flags(order=ordered or ties, presence=not q.get("columns") and not existence and bool(q["from"].get("joins")), governed=governed)
        source, aliases, _, _ = self.tree(q["from"], scope, "from", flags)
        scope.source = source
        scope.equal = list(self.equalities(q.get("where"), scope))
        where = [self.condition(scope, q["where"], f"{path}.where" if path else "where")] if q.get("where") else []
        if not existence and (grouping or q.get("limit") or q.get("offset")) and self.wants_outer(scope):
            scope.joins_outer = True
            where = [self.condition(scope, q["where"], f"{path}.where" if path else "where")]
            scope.joins_outer = False
        if not grouping and q.get("having"):  # R: filters rows
            where.append(self.condition(scope, q["having"], "having"))
        order_of_rows = "struct(" + ", ".join(f"{quoted(a)}._ord" for a in aliases) + ")" if flags.order else ""
        top: Scope = scope
        grouped = None
        if grouping:
            grouped = Grouping(q, scope, order_of_rows, self.j)
            top = Scope(relations=scope.relations, parent=outer, lookup=lambda a, f: grouped.first(a, f))
            for i, key in enumerate(q.get("groupBy") or ()):
                grouped.key(self, key, f"groupBy[{i}]")
            if self.j:
                grouped.validate()
        columns = self.columns(q, top, grouped, existence)
        keys = self.order_keys(q, top, grouped)
        having = [self.condition(top, q["having"], "having", grouped)] if grouping and q.get("having") else []
        last_key = "" if not ties else order_of_rows if grouped is None else grouped.add("o", "_ties", Term(f"min({order_of_rows})", "other")).sql
        names = [c[0] for c in columns]
        if not self.j or grouping:
            for n in {n for n in names if names.count(n) > 1}:
                raise QueryError("join_plan" if self.j else "shape", "columns", f"duplicate column {n}")
        outer_join, handed = self.outer_values(scope)
        source += outer_join
        where += handed
        if outer_join:  # as many rows as the level above may have: sizes of files tell too little to send them to every task
            flags.hints.append("MERGE(_outer)")
        hints = f"/*+ {', '.join(flags.hints)} */ " if flags.hints else ""
        where_sql = f" WHERE {' AND '.join(where)}" if where else ""
        if grouped is not None:
            inner = ", ".join(f"{t} AS {n}" for n, t in grouped.selected) or "count(1) AS _rows"
            by = f" GROUP BY {', '.join(grouped.keys_sql)}" if grouped.keys_sql else ""
            source, where_sql = f"(SELECT {hints}{inner} FROM {source}{where_sql}{by}) AS _q", f" WHERE {' AND '.join(having)}" if having else ""
            hints = ""
        if ties:
            keys.append((last_key, False))
        shown = ", ".join([f"{t.sql} AS {quoted(n)}" for n, t in columns] + [f"{k} AS _k{i}" for i, (k, _) in enumerate(keys)]) or "1 AS _one"
        sql = f"SELECT {hints}{shown} FROM {source}{where_sql}"
        tail = ""
        if keys:
            tail += " ORDER BY " + ", ".join(f"_k{i} {'DESC NULLS LAST' if d else 'ASC NULLS FIRST'}" for i, (_, d) in enumerate(keys))
        if q.get("limit"):
            tail += f" LIMIT {int(q['limit'])}"
        if q.get("offset"):
            tail += f" OFFSET {int(q['offset'])}"
        if keys:
            shown = ", ".join(quoted(n) for n in names) or "1 AS _one"
            # within a level the sort stands right under the limit: only there does a correlated limit keep its order
            sql = f"SELECT {shown} FROM ({sql}){tail}" if outer is None else f"SELECT {shown} FROM (SELECT * FROM ({sql}){tail})"
        elif tail:
            sql += tail
        return sql, [(n, t.kind, t.type) for n, t in columns], scope

    def outer_values(self, scope: Scope) -> tuple[str, list[str]]:
        """The join with the distinct outer values of fields that inner levels take from further out, and the
        conditions that tie them to the row of the level above."""
        if not scope.carries:
            return "", []
        home = scope.carries[0][3]
        if home is None or (home.lookup and not home.beside) or not home.source or any(h is not home or a not in home.relations for a, _, _, h in scope.carries):
            raise UnsupportedError("correlation over more than two levels, or into a grouped query, without equalities that hand the field on")
        names = [(scope.carried[a, n], sql) for a, n, sql, _ in scope.carries]
        values = ", ".join(f"{sql} AS {name}" for name, sql in names)
        return f" CROSS JOIN (SELECT DISTINCT {values} FROM {home.source}) AS _outer", [f"(_outer.{name} <=> {sql})" for name, sql in names]

    def equalities(self, c: Mapping[str, Any] | None, scope: Scope) -> Any:
        """Top-level conjuncts own.field == outer.field of a WHERE."""
        if not c:
            return
        for x in c.get("and", [c]):
            if x.get("op") in ("==", "eq") and "field" in x["left"] and "field" in x["right"]:
                sides = [(x[s].get("source"), x[s]["field"]) for s in ("left", "right")]
                for own, out in (sides, sides[::-1]):
                    if own[0] in scope.relations and out[0] is not None and out[0] not in scope.relations:
                        yield (*out, *own)

    def told_apart(self, q: Mapping[str, Any]) -> bool:
        """Whether ORDER BY names every group key just as GROUP BY does: no two groups tie."""
        plain = lambda e: {k: v for k, v in e.items() if k not in ("as", "desc")}
        return bool(q.get("groupBy")) and all(plain(k) in [plain(o) for o in q["orderBy"]] for k in q["groupBy"])

    def columns(self, q: Mapping[str, Any], scope: Scope, grouped: Grouping | None, existence: bool) -> list[tuple[str, Term]]:
        if existence:
            return []
        if not q.get("columns"):
            if grouped is not None and self.j:
                return [(k["field"], grouped.take(self, k, "groupBy")) for k in q.get("groupBy") or ()]
            return self.every_field(scope, grouped)
        out: list[tuple[str, Term]] = []
        for i, c in enumerate(q["columns"]):
            path = f"columns[{i}]"
            if "wildcard" in c:
                if grouped is not None:
                    raise QueryError("join_aggregate", path, "a wildcard in a grouped query")
                w = c["wildcard"]
                alias = w.get("source") or next(iter(scope.relations))
                if alias not in scope.relations:
                    raise QueryError("join_scope", path, f"unknown alias {alias}")
                for f in w.get("exclude") or ():
                    if f not in scope.relations[alias].fields:
                        raise QueryError("join_field", path, f"unknown field {alias}.{f}")
                for f in scope.relations[alias].fields:
                    if f not in (w.get("exclude") or ()):
                        if f in [n for n, _ in out]:
                            raise QueryError("join_plan", path, f"column {f} collides")
                        out.append((f, scope.term(alias, f)))
                continue
            t = self.expression(scope, c, path, grouped)
            name = c.get("as") or self.name(c, path)
            if self.j and "binary" in c:
                t = Term(self.finite(t.sql, f"join_plan at {path}: arithmetic overflow"), t.kind, t.type)
            if t.kind == "null":
                t = Term("CAST(NULL AS STRING)", "null", "string")
            out.append((name, t))
        if self.j and len({n for n, _ in out}) < len(out):
            raise QueryError("join_plan", "columns", "duplicate column names")
        return out

    def name(self, c: Mapping[str, Any], path: str) -> str:
        if "field" in c:
            return c["field"]
        if "query" in c and c["query"].get("as"):
            return c["query"]["as"]
        if "aggregate" in c:
            return aggregate_text(c["aggregate"]) if self.j else c["aggregate"]["function"].lower()
        raise QueryError("join_plan" if self.j else "shape", path, "the column needs an alias")

    def every_field(self, scope: Scope, grouped: Grouping | None) -> list[tuple[str, Term]]:
        """All fields, alias by alias: a later record's field overwrites an earlier one of the same name."""
        out: dict[str, Term] = {}
        for alias, r in scope.relations.items():
            for f in r.fields:
                t = scope.term(alias, f)
                if f in out and r.optional:
                    before = out[f]
                    sql = before.sql if before.kind == t.kind else f"CAST({before.sql} AS {t.type})"
                    t = Term(f"CASE WHEN {quoted(alias)}._here THEN {t.sql} ELSE {sql} END", t.kind, t.type)
                out[f] = t
        return list(out.items())

    def order_keys(self, q: Mapping[str, Any], scope: Scope, grouped: Grouping | None) -> list[tuple[str, bool]]:
        out = []
        for i, k in enumerate(q.get("orderBy") or ()):
            t = self.expression(scope, {n: v for n, v in k.items() if n != "desc"}, f"orderBy[{i}]", grouped)
            sql = t.sql
            if self.j and grouped is not None and "binary" in k:
                sql = self.finite(sql, f"join_plan at orderBy[{i}]: arithmetic overflow")
            out.append(("NULL" if t.kind == "null" else sql, bool(k.get("desc"))))
        return out

    # -- results -----------------------------------------------------------------------------------------

    def frame(self, q: Mapping[str, Any], governed: bool = False) -> DataFrame:
        sql, _, _ = self.query(q, None, "", governed=governed)
        return self.catalog.spark.sql(sql, args=self.args or None, **self.frames)


@dataclass
class Flags:
    order: bool = False
    presence: bool = False
    governed: bool = False
    hints: list[str] = field(default_factory=list)


class Grouping:
    """The inner aggregate of a grouped query: its keys and aggregates become columns g0.., a0.. of _q."""

    def __init__(self, q: Mapping[str, Any], scope: Scope, order: str, j: bool):
        self.q, self.scope, self.order, self.j = q, scope, order, j
        self.keys_sql: list[str] = []
        self.selected: list[tuple[str, str]] = []
        self.known: dict[str, Term] = {}

    def add(self, prefix: str, key: str, t: Term) -> Term:
        if key not in self.known:
            name = f"{prefix}{len(self.selected)}"
            self.selected.append((name, t.sql))
            self.known[key] = Term(f"_q.{name}", t.kind, t.type)
        return self.known[key]

    def canonical(self, compiler: Compiler, e: Mapping[str, Any], path: str) -> str:
        if "field" in e:
            source = e.get("source")
            owners = [a for a, r in self.scope.relations.items() if (source in (None, a)) and e["field"] in r.fields]
            return repr(("field", owners[0] if owners else source, e["field"]))
        return repr(sorted((k, v) for k, v in e.items() if k not in ("as", "desc")))

    def key(self, compiler: Compiler, e: Mapping[str, Any], path: str) -> None:
        t = compiler.expression(self.scope, e, path)
        self.keys_sql.append(t.sql)
        self.add("g", self.canonical(compiler, e, path), t)

    def take(self, compiler: Compiler, e: Mapping[str, Any], path: str) -> Term | None:
        key = self.canonical(compiler, e, path)
        if key in self.known:
            return self.known[key]
        if "aggregate" in e:
            return self.add("a", key, self.aggregate(compiler, e["aggregate"], path))
        return None

    def first(self, alias: str, name: str) -> Term:
        """A field of a grouped query: a key, or in R the group's first value."""
        key = repr(("field", alias, name))
        if key in self.known:
            return self.known[key]
        t = self.scope.relations[alias].fields[name]
        if self.j:
            raise QueryError("join_aggregate", name, f"{alias}.{name} is not a group key")
        return self.add("f", key, Term(f"min_by({t.sql}, {self.order})", t.kind, t.type))

    def aggregate(self, compiler: Compiler, a: Mapping[str, Any], path: str) -> Term:
        function, argument = a["function"].lower(), a["args"][0]
        distinct = "DISTINCT " if a.get("distinct") else ""
        if argument.get("star"):
            return Term("count(1)", "number", "bigint")
        t = compiler.expression(self.scope, argument, f"{path}.aggregate.args[0]")
        if function == "count":
            return Term("count(NULL)" if t.kind == "null" else f"count({distinct}{t.sql})", "number", "bigint")
        if function in ("sum", "avg"):
            number = compiler.number(t)
            if function == "avg":
                sql = f"avg({distinct}CAST({number} AS DOUBLE))"
                return Term(compiler.finite(sql, f"AVG numeric overflow at {path}"), "number", "double")
            if t.type.startswith(("bigint", "int", "smallint", "tinyint", "decimal")):
                return Term(f"sum({distinct}{number})", "number", t.type if t.type.startswith("decimal") else "bigint")
            return Term(compiler.finite(f"sum({distinct}CAST({number} AS DOUBLE))", f"SUM numeric overflow at {path}"), "number", "double")
        if function in ("min", "max"):
            return Term(f"{function}({t.sql})", t.kind, t.type)
        by = "min_by" if function == "first" else "max_by"
        only = "" if self.j else f" FILTER (WHERE {t.sql} IS NOT NULL)"
        return Term(f"{by}({t.sql}, {self.order}){only}", t.kind, t.type)

    def validate(self) -> None:
        """J: columns, HAVING and ORDER BY hold aggregates, group keys and literals inside expressions."""

        def walk(e: Any, path: str) -> None:
            if not isinstance(e, Mapping):
                return
            if "aggregate" in e:
                return
            if "field" in e:
                if self.canonical(None, e, path) not in self.known:
                    raise QueryError("join_aggregate", path, f"{e['field']} is not a group key")
                return
            for k, v in e.items():
                for i, x in enumerate(v if isinstance(v, list) else [v]):
                    walk(x, f"{path}.{k}" + f"[{i}]" * isinstance(v, list))

        for i, c in enumerate(self.q.get("columns") or ()):
            if "value" in c:
                raise QueryError("join_aggregate", f"columns[{i}]", "a bare literal in a grouped query")
            if "wildcard" not in c:
                walk(c, f"columns[{i}]")
        for i, k in enumerate(self.q.get("orderBy") or ()):
            walk(k, f"orderBy[{i}]")
        walk(self.q.get("having"), "having")


def _walk(q: Mapping[str, Any]) -> Any:
    """Every expression of the columns, HAVING and ORDER BY of one level, without inner queries."""

    def walk(e: Any) -> Any:
        if isinstance(e, Mapping):
            if "query" in e:
                return
            yield e
            for v in e.values():
                yield from walk(v)
        elif isinstance(e, list):
            for v in e:
                yield from walk(v)

    for part in ("columns", "having", "orderBy"):
        yield from walk(q.get(part))


def aggregates_of(q: Mapping[str, Any]) -> list[Mapping[str, Any]]:
    """Different aggregates of the columns, HAVING and ORDER BY of one level."""
    out: list[Mapping[str, Any]] = []
    for e in _walk(q):
        if "aggregate" in e and e["aggregate"] not in out:
            out.append(e["aggregate"])
    return out


def expression_text(e: Mapping[str, Any]) -> str:
    if e.get("star"):
        return "*"
    if "field" in e:
        return f"{e['source']}.{e['field']}" if e.get("source") else e["field"]
    if "binary" in e:
        return f"{expression_text(e['binary']['left'])} {e['binary']['op']} {expression_text(e['binary']['right'])}"
    value = e.get("value")
    return "null" if value is None else str(value).lower() if isinstance(value, bool) else f"'{value}'" if isinstance(value, str) else str(value)


def aggregate_text(a: Mapping[str, Any]) -> str:
    return f"{a['function'].upper()}({'DISTINCT ' * bool(a.get('distinct'))}{', '.join(expression_text(x) for x in a['args'])})"
