"""The text language: lexer, parser to a tree, and canonical printing.

    parameters (
      @Least integer default 2
    )
    with Busy as (
      from orders as o
      group by o.o_custkey
      select o.o_custkey, COUNT(*) as N
    )
    from customer as c
    join Busy as b on b.o_custkey = c.c_custkey
    where b.N >= @Least
    order by b.N desc
    limit 10
    select c.c_name, b.N

A clause starts a line; keywords are all lower or all upper case throughout; SELECT comes last. parse_text() never
raises: it gives the tree and diagnostics {code, message, span}.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

VERSION = 1
FORMAT = "lodetree"
# Limits of one document
MAX_CHARS, MAX_TOKENS, MAX_DEPTH, MAX_NODES, MAX_IMPORTS = 1 << 20, 1 << 18, 128, 5_000, 128

CLAUSES = ["from", "join", "where", "group", "having", "order", "limit", "offset", "select"]
RANK = {"from": 0, "join": 1, "where": 2, "group by": 3, "having": 4, "order by": 5, "limit": 6, "offset": 7, "select": 8}
KEYWORDS = {"databases", "parameters", "with", "as", "from", "join", "left", "on", "where", "group", "order", "by", "having", "limit", "offset", "select", "and", "or", "is", "not", "null", "true", "false", "asc", "desc", "required", "default", "using"}
TYPES = ["integer", "decimal", "string", "boolean", "date", "datetime", "timestamp"]
FUNCTIONS = {"count", "sum", "avg", "min", "max", "first", "last"}

_TOKEN = re.compile(
    r"(?P<space>[ \t\r\f\v]+)|(?P<line>\n)|(?P<comment>--[^\n]*|//[^\n]*)|(?P<string>'(?:[^']|'')*')|(?P<quoted>\"(?:[^\"]|\"\")*\"|`(?:[^`]|``)*`)"
    r"|(?P<param>@[A-Za-z_]\w*)|(?P<number>\d+(?:\.\d+)?)|(?P<word>[^\W\d]\w*)|(?P<symbol>::|<=|>=|!=|==|<>|[-+*/=<>(),.{}])"
)


class TextError(Exception):
    def __init__(self, code: str, message: str, span: tuple[int, int]):
        super().__init__(f"{code}: {message}")
        self.code, self.message, self.span = code, message, span


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    start: int
    end: int
    line: int
    first: bool  # of its line

    @property
    def lower(self) -> str:
        return self.text.lower() if self.kind == "word" else self.text


@dataclass
class Document:
    tree: dict[str, Any] | None
    diagnostics: list[dict[str, Any]] = field(default_factory=list)
    comments: list[dict[str, Any]] = field(default_factory=list)
    source: str = ""


def lex(source: str) -> tuple[list[Token], list[dict[str, Any]]]:
    """Tokens and comments; a comment's anchor is the number of the token that follows it."""
    if len(source) > MAX_CHARS:
        raise TextError("input_too_large", f"more than {MAX_CHARS} characters", (0, 0))
    tokens: list[Token] = []
    comments: list[dict[str, Any]] = []
    at, line, first = 0, 0, True
    while at < len(source):
        m = _TOKEN.match(source, at)
        if m is None:
            if source[at] in "'\"`":
                raise TextError("unterminated_quote", "the quote does not end", (at, len(source)))
            raise TextError("invalid_parameter" if source[at] == "@" else "unsupported_statement", f"unexpected {source[at]!r}", (at, at + 1))
        kind, text = m.lastgroup or "", m.group()
        if kind == "line":
            line, first = line + 1, True
        elif kind == "comment":
            comments.append({"text": text, "anchor": len(tokens), "line": line, "own_line": first})
        elif kind != "space":
            tokens.append(Token(kind, text, m.start(), m.end(), line, first))
            line += text.count("\n")
            first = False
            if len(tokens) > MAX_TOKENS:
                raise TextError("too_many_tokens", f"more than {MAX_TOKENS} tokens", (at, m.end()))
        at = m.end()
    tokens.append(Token("end", "", len(source), len(source), line, True))
    return tokens, comments


def unquoted(text: str) -> str:
    return text[1:-1].replace(text[0] * 2, text[0])


class Parser:
    def __init__(self, source: str):
        self.source = source
        self.tokens, self.comments = lex(source)
        self.at, self.depth, self.nodes = 0, 0, 0
        self.case: str | None = None

    # -- tokens ------------------------------------------------------------------------------------------

    @property
    def now(self) -> Token:
        return self.tokens[self.at]

    def fail(self, code: str, message: str, token: Token | None = None) -> TextError:
        t = token or self.now
        return TextError(code, message, (t.start, t.end))

    def is_word(self, *words: str, ahead: int = 0) -> bool:
        t = self.tokens[min(self.at + ahead, len(self.tokens) - 1)]
        return t.kind == "word" and t.lower in words

    def keyword(self, word: str, code: str = "unsupported_statement") -> Token:
        if not self.is_word(word):
            raise self.fail(code, f"expected {word}")
        t = self.now
        case = "lower" if t.text.islower() else "upper" if t.text.isupper() else None
        if case is None or self.case not in (None, case):
            raise self.fail("keyword_case", "keywords are all lower or all upper case")
        self.case = case
        self.at += 1
        return t

    def symbol(self, text: str, code: str, message: str) -> None:
        if self.now.text != text or self.now.kind != "symbol":
            raise self.fail(code, message)
        self.at += 1

    def is_symbol(self, *texts: str) -> bool:
        return self.now.kind == "symbol" and self.now.text in texts

    def node(self) -> None:
        self.nodes += 1
        if self.nodes > MAX_NODES:
            raise self.fail("document_node_limit", f"more than {MAX_NODES} nodes")

    def nest(self) -> None:
        self.depth += 1
        if self.depth > MAX_DEPTH:
            raise self.fail("nesting_limit", f"deeper than {MAX_DEPTH}")

    # -- documents ---------------------------------------------------------------------------------------

    def document(self) -> dict[str, Any]:
        out: dict[str, Any] = {"format": FORMAT, "version": VERSION}
        if self.is_word("databases"):
            out["databases"] = self.databases()
        if self.is_word("parameters"):
            out["parameters"] = self.parameters()
        definitions: list[dict[str, Any]] = []
        while self.is_word("with"):
            definitions.append(self.definition())
        if definitions:
            out["definitions"] = definitions
        if self.is_word("databases"):
            raise self.fail("nested_databases", "databases come first")
        if self.is_word("parameters"):
            raise self.fail("nested_parameters", "parameters come before definitions")
        out["query"] = self.query()
        if self.now.kind != "end":
            raise self.fail("multiple_statements", "text after the query")
        self.check_databases(out)
        return out

    def databases(self) -> list[dict[str, Any]]:
        self.keyword("databases")
        self.symbol("(", "invalid_databases", "expected (")
        out: list[dict[str, Any]] = []
        while not self.is_symbol(")"):
            if self.now.kind == "end":
                raise self.fail("unclosed_databases", "expected )")
            if self.now.kind not in ("word", "quoted"):
                raise self.fail("invalid_database", "expected a name")
            name = self.now.text if self.now.kind == "word" else unquoted(self.now.text)
            if name in [d["alias"] for d in out]:
                raise self.fail("duplicate_database", f"{name} is declared twice")
            self.at += 1
            entry = {"alias": name}
            if self.is_symbol("="):
                self.at += 1
                if self.now.kind != "string":
                    raise self.fail("invalid_database", "expected a quoted target")
                target = unquoted(self.now.text)
                if re.search(r"://[^/@]*:[^/@]*@|password\s*=", target, re.I):
                    raise self.fail("database_credentials", "targets hold no passwords")
                entry["target"] = target
                self.at += 1
            out.append(entry)
            if self.is_symbol(","):
                self.at += 1
        self.at += 1
        return out

    def check_databases(self, tree: Mapping[str, Any]) -> None:
        if "databases" not in tree:
            return
        used = {s["database"] for s in sources(tree) if s.get("database")}
        for name in used - {d["alias"] for d in tree["databases"]}:
            raise TextError("undeclared_database", f"{name} is not declared", (0, 0))
        for d in tree["databases"]:
            if d["alias"] not in used:
                raise TextError("unused_database", f"{d['alias']} is not used", (0, 0))

    def parameters(self) -> list[dict[str, Any]]:
        self.keyword("parameters")
        self.symbol("(", "invalid_parameters", "expected (")
        out: list[dict[str, Any]] = []
        while not self.is_symbol(")"):
            if self.now.kind == "end":
                raise self.fail("unclosed_parameters", "expected )")
            if self.now.kind != "param":
                raise self.fail("invalid_parameter", "expected @Name")
            p: dict[str, Any] = {"name": self.now.text[1:]}
            if p["name"] in [x["name"] for x in out]:
                raise self.fail("duplicate_parameter", f"@{p['name']} is declared twice")
            self.at += 1
            if self.now.kind != "word" or self.now.lower not in TYPES:
                raise self.fail("unsupported_parameter_type", "unknown type")
            p["type"] = self.now.lower
            self.at += 1
            if self.is_word("required"):
                self.keyword("required")
                p["required"] = True
            if self.is_word("default"):
                if p.get("required"):
                    raise self.fail("required_parameter_default", "a required parameter has no default")
                self.keyword("default")
                p["default"] = self.default_literal()
            out.append(p)
            if self.is_symbol(","):
                self.at += 1
        self.at += 1
        return out

    def default_literal(self) -> Any:
        sign = 1
        if self.is_symbol("-"):
            self.at, sign = self.at + 1, -1
        t = self.now
        self.at += 1
        if t.kind == "number":
            return sign * (float(t.text) if "." in t.text else int(t.text))
        if t.kind == "string" and sign == 1:
            return unquoted(t.text)
        if t.lower in ("true", "false", "null") and sign == 1:
            return {"true": True, "false": False, "null": None}[t.lower]
        raise self.fail("invalid_parameter_default", "expected a literal", t)

    def definition(self) -> dict[str, Any]:
        self.keyword("with")
        if self.now.kind not in ("word", "quoted"):
            raise self.fail("invalid_with", "expected a name")
        name = self.now.text if self.now.kind == "word" else unquoted(self.now.text)
        self.at += 1
        self.node()
        if self.is_word("as"):
            self.keyword("as")
            return {"name": name, "query": self.body("invalid_cte", "unclosed_cte")}
        if self.is_word("from"):
            self.keyword("from")
            if self.now.kind != "string":
                raise self.fail("invalid_with", "expected a quoted path")
            out: dict[str, Any] = {"name": name, "import": unquoted(self.now.text)}
            self.at += 1
            if self.is_word("using"):
                self.keyword("using")
                self.symbol("(", "invalid_using", "expected (")
                mapping: dict[str, Any] = {}
                while not self.is_symbol(")"):
                    if self.now.kind == "end":
                        raise self.fail("unclosed_using", "expected )")
                    if self.now.kind != "param":
                        raise self.fail("invalid_mapping", "expected @Name = value")
                    parameter = self.now.text[1:]
                    if parameter in mapping:
                        raise self.fail("duplicate_import_mapping", f"@{parameter} is mapped twice")
                    self.at += 1
                    self.symbol("=", "invalid_mapping", "expected =")
                    mapping[parameter] = self.expression()
                    if self.is_symbol(","):
                        self.at += 1
                self.at += 1
                out["using"] = mapping
            return out
        raise self.fail("invalid_with", "expected as or from")

    def body(self, open_code: str, close_code: str) -> dict[str, Any]:
        self.symbol("(", open_code, "expected (")
        self.nest()
        definitions: list[dict[str, Any]] = []
        while self.is_word("with"):
            definitions.append(self.definition())
        q = self.query()
        if definitions:
            q = {"definitions": definitions, **q}
        self.symbol(")", close_code, "expected )")
        self.depth -= 1
        return q

    # -- queries -----------------------------------------------------------------------------------------

    def clause_name(self) -> str | None:
        t = self.now
        if t.kind != "word":
            return None
        w = t.lower
        if w == "left" and self.is_word("join", ahead=1):
            return "join"
        if w in ("group", "order") and self.is_word("by", ahead=1):
            return f"{w} by"
        return w if w in RANK else None

    def query(self) -> dict[str, Any]:
        out: dict[str, Any] = {}
        self.node()
        if self.clause_name() != "from":
            raise self.fail("expected_from" if self.clause_name() else "unsupported_statement", "a query starts with from")
        rank, last = -1, ""
        while (name := self.clause_name()) is not None:
            t = self.now
            if out and not t.first:
                raise self.fail("multiple_clauses_same_line", "a clause starts a line")
            if name != "join" and name in out:
                raise self.fail("duplicate_clause", f"{name} occurs twice")
            if last == "select":
                raise self.fail("select_must_be_last", "select is the last clause")
            if RANK[name] < rank:
                raise self.fail("clause_order", f"{name} comes before {last}")
            rank, last = RANK[name], name
            if name == "join":
                out.setdefault("joins", []).append(self.join())
                continue
            for w in name.split():
                self.keyword(w)
            code = f"invalid_{name.replace(' ', '_')}"
            try:
                out[name] = self.clause(name)
            except TextError as e:
                if e.code == "invalid_expression":
                    raise TextError("invalid_condition" if name in ("where", "having") else code, e.message, e.span) from e
                raise
        if self.now.kind == "word" and self.now.first and not self.is_symbol(")"):
            raise self.fail("unsupported_clause", f"unknown clause {self.now.text}")
        if self.now.kind not in ("end",) and not self.is_symbol(")") and not self.is_word("with"):
            raise self.fail("unsupported_clause", f"unexpected {self.now.text}")
        return out

    def clause(self, name: str) -> Any:
        if name == "from":
            return self.table("invalid_from")
        if name in ("where", "having"):
            return self.condition()
        if name in ("limit", "offset"):
            if self.now.kind == "param":
                self.at += 1
                return {"param": self.tokens[self.at - 1].text[1:]}
            if self.now.kind != "number" or "." in self.now.text:
                raise self.fail("invalid_limit" if name == "limit" else "invalid_offset", "expected a whole number")
            self.at += 1
            return int(self.tokens[self.at - 1].text)
        if name == "group by":
            return self.listed(self.expression)
        if name == "order by":
            return self.listed(self.order_key)
        if self.is_symbol("(") and self.block_of_items():
            self.at += 1
            self.nest()
            items = []
            while not self.is_symbol(")"):
                if self.now.kind == "end":
                    raise self.fail("invalid_select", "expected )")
                items.append(self.item())
                if self.is_symbol(","):
                    self.at += 1
            self.at += 1
            self.depth -= 1
            if not items:
                raise self.fail("invalid_select", "nothing selected")
            return items
        start = self.at
        out = [] if self.now.first else self.listed(self.item)
        if not out or any(t.first for t in self.tokens[start + 1 : self.at]):
            raise self.fail("invalid_select", "a select over several lines needs ( on its first")
        return out

    def block_of_items(self) -> bool:
        return self.tokens[self.at + 1].first

    def listed(self, one: Any) -> list[Any]:
        out = [one()]
        while self.is_symbol(","):
            self.at += 1
            out.append(one())
        return out

    def order_key(self) -> dict[str, Any]:
        e = self.expression()
        if self.is_word("asc", "desc"):
            e = {**e, "desc": True} if self.is_word("desc") else e
            self.keyword(self.now.lower)
        return e

    def join(self) -> dict[str, Any]:
        out: dict[str, Any] = {"type": "inner"}
        if self.is_word("left"):
            self.keyword("left")
            out["type"] = "left"
        self.keyword("join")
        out["source"] = self.table("invalid_join")
        if self.is_word("on"):
            self.keyword("on")
            c = self.condition()
            if "field" in c and not c.get("source"):
                out["shorthand"] = c["field"]
            else:
                out["on"] = c
        return out

    def table(self, code: str) -> dict[str, Any]:
        if self.now.kind not in ("word", "quoted") and not self.is_symbol("{"):
            raise self.fail(code, "expected a source")
        out = self.path()
        if self.is_word("as"):
            self.keyword("as")
            if self.now.kind not in ("word", "quoted"):
                raise self.fail(code, "expected an alias")
            out["alias"] = self.now.text if self.now.kind == "word" else unquoted(self.now.text)
            self.at += 1
        return out

    def path(self) -> dict[str, Any]:
        out: dict[str, Any] = {}
        first = self.segment()
        if self.is_symbol("::"):
            if not isinstance(first, str):
                raise self.fail("invalid_database_qualifier", "expected a name before ::")
            self.at += 1
            out["database"] = first
            first = self.segment()
        segments, separator = [first], None
        while self.is_symbol(".", "/"):
            t = self.now
            if t.start != self.tokens[self.at - 1].end:
                raise self.fail("detached_path_separator", "no space around a separator")
            if separator not in (None, t.text):
                raise self.fail("mixed_path_separators", "either . or /")
            separator = t.text
            self.at += 1
            if self.now.start != t.end:
                raise self.fail("empty_path_segment", "expected a segment")
            segments.append(self.segment())
        if separator == "/" or any(not isinstance(s, str) for s in segments):
            out["path"] = segments
        elif len(segments) > 2:
            out["path"] = segments
        else:
            out.update(name=segments[-1], **({"schema": segments[0]} if len(segments) == 2 else {}))
        return out

    def segment(self) -> Any:
        t = self.now
        if t.kind == "word":
            self.at += 1
            return t.text
        if t.kind == "quoted":
            text = unquoted(t.text)
            if not text or "/" in text:
                raise self.fail("invalid_quoted_segment", "empty or with a separator")
            self.at += 1
            return text
        if self.is_symbol("{"):
            self.at += 1
            if self.now.kind != "word":
                raise self.fail("invalid_substituted_segment", "expected {name}")
            name = self.now.text
            self.at += 1
            self.symbol("}", "invalid_substituted_segment", "expected }")
            return {"variable": name}
        raise self.fail("empty_path_segment" if self.is_symbol(".", "/") else "invalid_path_segment", "expected a segment")

    # -- expressions -------------------------------------------------------------------------------------

    def item(self) -> dict[str, Any]:
        self.node()
        if self.now.kind in ("word", "quoted") and self.is_word("as", ahead=1) and self.tokens[self.at + 2].text == "(":
            name = self.now.text if self.now.kind == "word" else unquoted(self.now.text)
            self.at += 1
            self.keyword("as")
            return {"query": self.body("invalid_scalar_query", "invalid_scalar_query"), "as": name}
        e = self.expression()
        if self.is_word("as"):
            self.keyword("as")
            if self.now.kind not in ("word", "quoted"):
                raise self.fail("invalid_select", "expected an alias")
            e = {**e, "as": self.now.text if self.now.kind == "word" else unquoted(self.now.text)}
            self.at += 1
        return e

    def condition(self) -> dict[str, Any]:
        parts = [self.conjunction()]
        while self.is_word("or"):
            self.keyword("or")
            parts.append(self.conjunction())
        return parts[0] if len(parts) == 1 else {"or": parts}

    def conjunction(self) -> dict[str, Any]:
        parts = [self.test()]
        while self.is_word("and"):
            self.keyword("and")
            parts.append(self.test())
        return parts[0] if len(parts) == 1 else {"and": parts}

    def test(self) -> dict[str, Any]:
        self.node()
        self.nest()
        if self.is_symbol("("):
            back = self.at
            self.at += 1
            try:
                c = self.condition()
                if self.is_symbol(")") and ("op" in c or "and" in c or "or" in c or "isNull" in c or "isNotNull" in c):
                    self.at += 1
                    self.depth -= 1
                    return c
            except TextError:
                pass
            self.at = back
        left = self.expression()
        self.depth -= 1
        if self.is_word("is"):
            self.keyword("is")
            negated = self.is_word("not")
            if negated:
                self.keyword("not")
            self.keyword("null", "invalid_condition")
            return {"isNotNull" if negated else "isNull": left}
        if self.is_symbol("=", "==", "!=", "<>", "<", "<=", ">", ">="):
            op = self.now.text
            self.at += 1
            return {"op": "==" if op == "=" else op, "left": left, "right": self.expression()}
        if "field" in left:
            return left
        raise self.fail("invalid_condition", "expected a comparison")

    def expression(self, least: int = 0) -> dict[str, Any]:
        self.node()
        self.nest()
        left = self.primary()
        while self.is_symbol("+", "-", "*", "/"):
            op = self.now.text
            power = 10 if op in "+-" else 20
            if power <= least:
                break
            self.at += 1
            left = {"binary": {"op": op, "left": left, "right": self.expression(power)}}
        self.depth -= 1
        return left

    def primary(self) -> dict[str, Any]:
        t = self.now
        if t.kind == "number":
            self.at += 1
            if "." in t.text or int(t.text) >= 1 << 53:
                raise self.fail("invalid_expression", "whole numbers below 2^53 only", t)
            return {"value": int(t.text)}
        if t.kind == "string":
            self.at += 1
            return {"value": unquoted(t.text)}
        if t.kind == "param":
            self.at += 1
            return {"param": t.text[1:]}
        if self.is_symbol("*"):
            self.at += 1
            return {"star": True}
        if self.is_symbol("("):
            self.at += 1
            e = self.expression()
            self.symbol(")", "invalid_expression", "expected )")
            return e
        if t.kind == "word" and t.lower in ("true", "false", "null"):
            self.keyword(t.lower)
            return {"value": {"true": True, "false": False, "null": None}[t.lower]}
        if t.kind in ("word", "quoted") and not (t.kind == "word" and t.lower in KEYWORDS):
            name = t.text if t.kind == "word" else unquoted(t.text)
            self.at += 1
            if t.kind == "word" and self.is_symbol("("):
                return self.call(name)
            if self.is_symbol("."):
                self.at += 1
                n = self.now
                if n.kind not in ("word", "quoted"):
                    raise self.fail("invalid_expression", "expected a field")
                self.at += 1
                return {"field": n.text if n.kind == "word" else unquoted(n.text), "source": name}
            return {"field": name}
        raise self.fail("invalid_expression", f"unexpected {t.text or 'end'}")

    def call(self, name: str) -> dict[str, Any]:
        self.at += 1
        arguments = []
        while not self.is_symbol(")"):
            arguments.append(self.expression())
            if self.is_symbol(","):
                self.at += 1
            elif not self.is_symbol(")"):
                raise self.fail("unsupported_aggregate_order" if self.is_word("order") else "invalid_expression", "expected , or )")
        self.at += 1
        if name.lower() in FUNCTIONS:
            return {"aggregate": {"function": name.lower(), "args": arguments}}
        return {"call": {"name": name, "args": arguments}}


def sources(tree: Any) -> Any:
    """Every source of a tree."""
    if isinstance(tree, Mapping):
        for k, v in tree.items():
            if k in ("from", "source") and isinstance(v, Mapping) and ("name" in v or "path" in v):
                yield v
            yield from sources(v)
    elif isinstance(tree, list):
        for v in tree:
            yield from sources(v)


def parse_text(source: str) -> Document:
    try:
        parser = Parser(source)
        return Document(parser.document(), [], parser.comments, source)
    except TextError as e:
        return Document(None, [{"code": e.code, "message": e.message, "span": e.span}], [], source)


# --- printing -----------------------------------------------------------------------------------------------


class Printer:
    def __init__(self, upper: bool = False, indent: str = "  "):
        self.upper, self.indent = upper, indent

    def word(self, words: str) -> str:
        return words.upper() if self.upper else words

    def name(self, text: str) -> str:
        plain = re.fullmatch(r"[^\W\d]\w*", text) and text.lower() not in KEYWORDS
        return text if plain else '"' + text.replace('"', '""') + '"'

    def literal(self, v: Any) -> str:
        if v is None or isinstance(v, bool):
            return self.word({None: "null", True: "true", False: "false"}[v])
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        if isinstance(v, float) or v < 0:
            raise TextError("unsupported_print", "the text has no negative or decimal literals", (0, 0))
        return str(v)

    def expression(self, e: Mapping[str, Any], least: int = 0) -> str:
        if "field" in e:
            return f"{self.name(e['source'])}.{self.name(e['field'])}" if e.get("source") else self.name(e["field"])
        if "value" in e:
            return self.literal(e["value"])
        if "param" in e:
            return f"@{e['param']}"
        if e.get("star"):
            return "*"
        if "binary" in e:
            b = e["binary"]
            power = 10 if b["op"] in "+-" else 20
            out = f"{self.expression(b['left'], power - 1)} {b['op']} {self.expression(b['right'], power)}"
            return f"({out})" if power <= least else out
        if "aggregate" in e:
            if e["aggregate"].get("distinct"):
                raise TextError("unsupported_print", "the text has no distinct", (0, 0))
            return f"{e['aggregate']['function'].upper()}({', '.join(self.expression(a) for a in e['aggregate']['args'])})"
        if "call" in e:
            return f"{e['call']['name']}({', '.join(self.expression(a) for a in e['call']['args'])})"
        raise TextError("unsupported_print", f"the text has no {', '.join(e)}", (0, 0))

    def condition(self, c: Mapping[str, Any], inner: bool = False) -> str:
        for w in ("and", "or"):
            if w in c:
                out = f" {self.word(w)} ".join(self.condition(x, True) for x in c[w])
                return f"({out})" if inner else out
        if "isNull" in c:
            return f"{self.expression(c['isNull'])} {self.word('is null')}"
        if "isNotNull" in c:
            return f"{self.expression(c['isNotNull'])} {self.word('is not null')}"
        if "op" not in c or c["op"] in ("In", "NotIn", "in", "not-in"):
            raise TextError("unsupported_print", "the text has no such condition", (0, 0))
        return f"{self.expression(c['left'])} {'=' if c['op'] in ('==', 'eq') else c['op']} {self.expression(c['right'])}"

    def table(self, s: Mapping[str, Any]) -> str:
        if "path" in s:
            text = "/".join(self.name(x) if isinstance(x, str) else "{" + x["variable"] + "}" for x in s["path"])
        else:
            text = ".".join(self.name(s[k]) for k in ("schema", "name") if s.get(k))
        text = f"{self.name(s['database'])}::{text}" if s.get("database") else text
        return f"{text} {self.word('as')} {self.name(s['alias'])}" if s.get("alias") else text

    def query(self, q: Mapping[str, Any], level: int = 0) -> list[str]:
        pad = self.indent * level
        out = self.definitions(q.get("definitions") or (), level)
        out.append(f"{pad}{self.word('from')} {self.table(q['from'])}")
        for j in q.get("joins") or ():
            on = f" {self.word('on')} {self.condition(j['on'])}" if "on" in j else f" {self.word('on')} {self.name(j['shorthand'])}" if "shorthand" in j else ""
            out.append(f"{pad}{self.word('left join' if j['type'] == 'left' else 'join')} {self.table(j['source'])}{on}")
        for name in ("where", "having"):
            if name == "having" and "group by" in q:
                out.append(f"{pad}{self.word('group by')} {', '.join(self.expression(e) for e in q['group by'])}")
            if name in q:
                out.append(f"{pad}{self.word(name)} {self.condition(q[name])}")
        if "order by" in q:
            keys = [self.expression(k) + (f" {self.word('desc')}" if k.get("desc") else "") for k in q["order by"]]
            out.append(f"{pad}{self.word('order by')} {', '.join(keys)}")
        for name in ("limit", "offset"):
            if name in q:
                out.append(f"{pad}{self.word(name)} {q[name] if isinstance(q[name], int) else '@' + q[name]['param']}")
        if "select" in q:
            if any("query" in i for i in q["select"]):
                out.append(f"{pad}{self.word('select')} (")
                for i in q["select"]:
                    out += self.item(i, level + 1)
                out.append(f"{pad})")
            else:
                out.append(f"{pad}{self.word('select')} {', '.join(self.item(i, 0)[0] for i in q['select'])}")
        return out

    def item(self, i: Mapping[str, Any], level: int) -> list[str]:
        pad = self.indent * level
        if "query" in i:
            return [f"{pad}{self.name(i['as'])} {self.word('as')} (", *self.query(i["query"], level + 1), f"{pad})"]
        return [pad + self.expression(i) + (f" {self.word('as')} {self.name(i['as'])}" if i.get("as") else "")]

    def definitions(self, definitions: Any, level: int) -> list[str]:
        pad, out = self.indent * level, []
        for d in definitions:
            if "import" in d:
                out.append(f"{pad}{self.word('with')} {self.name(d['name'])} {self.word('from')} {self.literal(d['import'])}")
                if d.get("using"):
                    out.append(f"{pad}{self.word('using')} ( {', '.join(f'@{k} = {self.expression(v)}' for k, v in d['using'].items())} )")
            else:
                out += [f"{pad}{self.word('with')} {self.name(d['name'])} {self.word('as')} (", *self.query(d["query"], level + 1), f"{pad})"]
        return out

    def document(self, tree: Mapping[str, Any]) -> str:
        out: list[str] = []
        if tree.get("databases"):
            out += [f"{self.word('databases')} (", *(self.indent + self.name(d["alias"]) + (f" = {self.literal(d['target'])}" if "target" in d else "") for d in tree["databases"]), ")"]
        if tree.get("parameters"):
            out.append(f"{self.word('parameters')} (")
            for p in tree["parameters"]:
                rest = f" {self.word('required')}" if p.get("required") else ""
                if "default" in p:
                    v = p["default"]
                    rest = f" {self.word('default')} {v if isinstance(v, (int, float)) and not isinstance(v, bool) else self.literal(v)}"
                out.append(f"{self.indent}@{p['name']} {p['type']}{rest}")
            out.append(")")
        out += self.definitions(tree.get("definitions") or (), 0)
        return "\n".join(out + self.query(tree["query"])) + "\n"


#: Keywords that an opening bracket may follow; before one, any other word names a function.
_OPENING = {"databases", "parameters", "as", "using", "select", "on", "where", "having", "and", "or", "by", "not"}


def format_text(source: str, *, keywords: str = "preserve", indentation: str = "two-spaces") -> str:
    """The text with its keywords in one case and its lines indented by their blocks; nothing else changes.

    keywords: lower, upper or preserve (the case of the first keyword). indentation: two-spaces, tab or preserve (tab
    where every indented line starts with one). A text whose quotes or selects run over lines in a way the language
    does not have comes back as it is.
    """
    try:
        tokens, _ = lex(source)
    except TextError:
        return source
    if any(t.kind in ("string", "quoted") and re.search(r"[\r\n]", t.text) for t in tokens) or _broken_select(tokens):
        return source
    words = [t for i, t in enumerate(tokens) if _is_keyword(tokens, i)]
    upper = keywords == "upper" or (keywords == "preserve" and bool(words) and words[0].text.isupper())
    out, at = [], 0
    for t in words:
        out += [source[at : t.start], t.text.upper() if upper else t.text.lower()]
        at = t.end
    lines = "".join([*out, source[at:]]).split("\n")
    indented = [x for x in lines if x[:1] in (" ", "\t")]
    tab = indentation == "tab" or (indentation == "preserve" and bool(indented) and all(x.startswith("\t") for x in indented))
    unit = "\t" if tab else "  "
    depth, result = 0, []
    by_line: dict[int, list[Token]] = {}
    for t in tokens:
        by_line.setdefault(t.line, []).append(t)
    for n, line in enumerate(lines):
        own = [t for t in by_line.get(n, ()) if t.kind != "end"]
        closing = bool(own) and own[0].text == ")"
        level = max(0, depth - closing)
        result.append(unit * level + line.strip() if line.strip() else "")
        depth += sum((t.text == "(") - (t.text == ")") for t in own if t.kind == "symbol")
    return "\n".join(result)


def _is_keyword(tokens: list[Token], i: int) -> bool:
    t = tokens[i]
    if t.kind != "word" or t.lower not in KEYWORDS or (i and tokens[i - 1].text in (".", "::", "/", "{")):
        return False
    after = tokens[i + 1]
    if after.text in (".", "::") or (after.text == "(" and t.lower not in _OPENING):
        return False
    return not (i and tokens[i - 1].lower == "as" and after.text != "(" and not t.first)


def _broken_select(tokens: list[Token]) -> bool:
    """Whether a select goes on over lines without the ( of a block at the end of its first."""
    for i, t in enumerate(tokens):
        if t.lower != "select" or not _is_keyword(tokens, i):
            continue
        rest = []
        for u in tokens[i + 1 :]:
            if u.first or u.kind == "end":
                break
            rest.append(u.text)
        if not rest or (rest.count("(") > rest.count(")") and rest != ["("]):
            return True
    return False
