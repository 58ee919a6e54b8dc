"""Exact money: sums in minor units, averages and quotients rounded half-even, results as decimal text.

Everything runs on whole numbers of minor units (DECIMAL(38, 0)), JVM-side: a quotient's remainder decides the
rounding, as Spark's decimal division would cut the scale.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeframe.errors import QueryError

TEXT = r"^-?(0|[1-9][0-9]{0,37})(\.[0-9]+)?$"


def minor_units(value: Column, scale: int, path: str = "money") -> Column:
    """Whole minor units of decimal text or whole numbers; what has more places, or is no decimal, is an error."""
    text = value.cast("string")
    places = F.length(F.regexp_extract(text, r"\.([0-9]+)$", 1))
    fine = text.rlike(TEXT) & (places <= scale)
    units = F.concat(F.regexp_extract(text, r"^-?[0-9]+", 0), F.rpad(F.regexp_extract(text, r"\.([0-9]+)$", 1), scale, "0") if scale else F.lit("")).cast("decimal(38,0)")
    return F.when(value.isNull(), F.lit(None)).when(fine, units).otherwise(F.raise_error(F.lit(f"money at {path}: not an amount of {scale} places")).cast("decimal(38,0)"))


def _let(values: list[Column], use: Callable[..., Column]) -> Column:
    """use(*values), with each value computed once for each row."""
    named = F.struct(*[v.alias(f"v{i}") for i, v in enumerate(values)])
    return F.get(F.transform(F.array(named), lambda s: use(*[s[f"v{i}"] for i in range(len(values))])), F.lit(0))


def half_even(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator as a whole number, ties to even. The denominator is not 0."""
    return _let([numerator, denominator], _half_even)


def _half_even(numerator: Column, denominator: Column) -> Column:
    n, d = F.abs(numerator), F.abs(denominator)
    whole = _floor_div(n, d)
    twice = (n - whole * d) * 2
    up = (twice > d) | ((twice == d) & (F.pmod(whole, F.lit(2)) == 1))
    size = (whole + F.when(up, F.lit(1)).otherwise(F.lit(0))).cast("decimal(38,0)")
    return F.when((numerator < 0) != (denominator < 0), -size).otherwise(size)


def _floor_div(n: Column, d: Column) -> Column:
    """Whole quotient of non-negative decimals without a fraction, exact at any size."""
    return ((n - F.pmod(n, d)) / d).cast("decimal(38,0)")


def as_text(units: Column, scale: int) -> Column:
    """Units of 10**-scale as decimal text without trailing zeros."""
    return _let([units], lambda u: _as_text(u, scale))


def _as_text(units: Column, scale: int) -> Column:
    digits = F.lpad(F.abs(units).cast("string"), F.greatest(F.length(F.abs(units).cast("string")), F.lit(scale + 1)), F.lit("0"))
    whole = F.substring(digits, F.lit(1), F.length(digits) - scale)
    part = F.regexp_replace(F.substring(digits, F.length(digits) - scale + 1, F.lit(scale)) if scale else F.lit(""), "0+$", "")
    text = F.when(part == "", whole).otherwise(F.concat(whole, F.lit("."), part))
    return F.when((units < 0) & (text != "0"), F.concat(F.lit("-"), text)).otherwise(text)


def money_sum(value: Column, scale: int) -> Column:
    return as_text(F.sum(minor_units(value, scale)), scale)


def money_avg(value: Column, scale: int, division_scale: int) -> Column:
    units = minor_units(value, scale)
    return as_text(_ratio(F.sum(units), F.count(units).cast("decimal(38,0)"), scale, division_scale), division_scale)


def _ratio(total: Column, count: Column, scale: int, division_scale: int) -> Column:
    """total (of `scale` places) / count in units of `division_scale` places."""
    shift = division_scale - scale
    n = (total * F.lit(10**shift)).cast("decimal(38,0)") if shift >= 0 else total
    d = count if shift >= 0 else (count * F.lit(10**-shift)).cast("decimal(38,0)")
    return F.when(count != 0, half_even(n, F.when(count == 0, F.lit(1)).otherwise(d).cast("decimal(38,0)")))


def divided(a: Column, b: Column, scale: int, division_scale: int) -> Column:
    """a / b of two amounts as text; division by zero is an error."""
    x, y = minor_units(a, scale), minor_units(b, scale)
    up = (x * F.lit(10**division_scale)).cast("decimal(38,0)")
    safe = F.when(y == 0, F.raise_error(F.lit("money at /: division by zero")).cast("decimal(38,0)")).otherwise(y)
    return as_text(half_even(up, safe), division_scale)


def money_frame(catalog: Any, query: Any) -> DataFrame:
    """A J document with a money part: one flat join, SUM, AVG, COUNT and / only."""
    from lodeframe.plans.compile import Compiler

    q = dict(query.body)
    rules = q.pop("money")
    scale, division = rules["minorUnitScale"], rules["divisionScale"]
    columns = q.pop("columns", [])
    rest = {k: q.pop(k) for k in ("having", "orderBy", "limit", "offset") if k in q}
    if "having" in rest:
        raise QueryError("join_plan", "having", "not with exact money")
    groups = q.pop("groupBy", [])
    needed: list[dict[str, Any]] = []

    def inner(e: dict[str, Any]) -> Column:
        if e not in needed:
            needed.append(e)
        return F.col(f"_m{needed.index(e)}")

    def build(c: dict[str, Any], path: str) -> Column:
        if "aggregate" in c:
            a = c["aggregate"]
            argument = a["args"][0]
            if a["function"] == "count":
                return F.count(F.lit(1)) if argument.get("star") else F.count(inner(argument))
            if a["function"] == "sum":
                return money_sum(inner(argument), scale)
            if a["function"] == "avg":
                return money_avg(inner(argument), scale, division)
            raise QueryError("join_plan", path, "SUM, AVG and COUNT only with exact money")
        if "binary" in c:
            if c["binary"]["op"] != "/":
                raise QueryError("join_plan", path, "only / with exact money")
            return divided(inner(c["binary"]["left"]), inner(c["binary"]["right"]), scale, division)
        return inner({k: v for k, v in c.items() if k != "as"})

    def name(c: dict[str, Any]) -> str:
        from lodeframe.plans.compile import aggregate_text

        return c.get("as") or c.get("field") or aggregate_text(c["aggregate"])

    grouped = bool(groups) or any("aggregate" in c for c in columns)
    built = [(name(c), build(c, f"columns[{i}]"), c) for i, c in enumerate(columns)]
    keys = [inner({k: v for k, v in g.items()}) for g in groups]
    base = Compiler(catalog, "J").frame({**q, "columns": [{**e, "as": f"_m{i}"} for i, e in enumerate(needed)]})
    if grouped:
        plain = {n for n, _, c in built if "aggregate" not in c}
        out = base.groupBy(*keys).agg(*[(F.first(c) if n in plain else c).alias(n) for n, c, _ in built]).select(*[F.col(f"`{n}`") for n, _, _ in built])
    else:
        out = base.select(*[c.alias(n) for n, c, _ in built])
    if rest.get("orderBy"):
        out = out.orderBy(*[F.col(k["field"]).desc_nulls_last() if k.get("desc") else F.col(k["field"]).asc_nulls_first() for k in rest["orderBy"]])
    if rest.get("offset"):
        out = out.offset(rest["offset"])
    return out.limit(rest["limit"]) if rest.get("limit") else out
