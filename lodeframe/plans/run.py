"""Running queries: documents, text or builders in, DataFrames out."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from lodeframe.errors import QueryError
from lodeframe.plans.compile import Compiler
from lodeframe.plans.document import Query, parse
from lodeframe.sources.catalog import Catalog, plain_value


def to_frame(catalog: Catalog, query: Query | str | Mapping[str, Any], *, dialect: str | None = None, max_limit: int = 1000, governed: bool = False) -> DataFrame:
    """The lazy DataFrame of a query; nothing runs before its first action."""
    q = query if isinstance(query, Query) else parse(query, dialect=dialect, max_limit=max_limit)
    if q.body.get("money"):
        from lodeframe.functions.money import money_frame

        return money_frame(catalog, q)
    return Compiler(catalog, q.dialect).frame(q.body, governed=governed)


def check_overflow(catalog: Catalog, query: Query | str | Mapping[str, Any], *, dialect: str | None = None) -> None:
    """Evaluates every aggregate of every group, also of groups that HAVING or LIMIT would drop: an overflow anywhere
    is an error. One more pass over the input, so it is asked for."""
    from lodeframe.plans.compile import aggregates_of

    q = query if isinstance(query, Query) else parse(query, dialect=dialect)
    found = aggregates_of(q.body)
    if found:
        body = {k: q.body[k] for k in ("from", "where", "groupBy") if k in q.body}
        body["columns"] = [{"aggregate": a, "as": f"a{i}"} for i, a in enumerate(found)]
        try:
            Compiler(catalog, q.dialect).frame(body).write.format("noop").mode("overwrite").save()
        except Exception as e:
            raise translated(e) from e


def observed(df: DataFrame, name: str = "progress") -> tuple[DataFrame, Observation]:
    """df with a count of the rows that pass, to be read when the query is over."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


@contextmanager
def cancellable(spark: SparkSession, tag: str) -> Iterator[Callable[[], Any]]:
    """Queries run inside can be cancelled from another thread by calling what this gives."""
    spark.addTag(tag)
    try:
        yield lambda: spark.interruptTag(tag)
    finally:
        spark.removeTag(tag)


def run(catalog: Catalog, query: Query | str | Mapping[str, Any], **options: Any) -> list[dict[str, Any]]:
    """Rows of a query as dicts; what Spark raises inside a query comes as QueryError."""
    try:
        return [plain_row(r) for r in to_frame(catalog, query, **options).collect()]
    except QueryError:
        raise
    except Exception as e:
        raise translated(e) from e


def translated(e: Exception) -> Exception:
    text = str(e)
    if "SCALAR_SUBQUERY_TOO_MANY_ROWS" in text:
        return QueryError("cardinality", "query", "a scalar query gave more than one row")
    if "USER_RAISED_EXCEPTION" in text:
        said = text.split("[USER_RAISED_EXCEPTION]", 1)[1].strip().split(" SQLSTATE")[0].rstrip(".").split("\n")[0]
        code, _, rest = said.partition(" at ")
        path, _, reason = rest.partition(": ")
        return QueryError(code, path, reason or said)
    return e


def plain_row(r: Row) -> dict[str, Any]:
    return {k: plain_value(v) if isinstance(v, Row) and set(v.asDict()) == {"r", "n", "s"} else v for k, v in r.asDict().items()}


def pages(df: DataFrame, size: int = 500) -> Iterator[list[dict[str, Any]]]:
    """Rows page by page (1 to 1000 a page), a partition at a time: the driver holds one partition at most."""
    if not 1 <= size <= 1000:
        raise QueryError("join_plan", "pageSize", "from 1 to 1000")
    page: list[dict[str, Any]] = []
    for r in df.toLocalIterator(prefetchPartitions=True):
        page.append(plain_row(r))
        if len(page) == size:
            yield page
            page = []
    if page:
        yield page


def bounded(df: DataFrame, rows: int, what: str = "result rows") -> DataFrame:
    """df, after checking that it has at most so many rows (an action over at most rows + 1 of them)."""
    if df.limit(rows + 1).count() > rows:
        raise QueryError("query_limit", what, f"more than {rows}")
    return df
