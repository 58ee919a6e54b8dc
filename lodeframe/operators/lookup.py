"""Enrichment by lookup: of tables by a join, of services by concurrent calls within each Arrow batch."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor, as_completed
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeframe.errors import QueryError

#: Bytes of a dimension that is sent to every task; larger ones are joined by shuffle.
BROADCAST_BYTES = 64 << 20


def estimated_bytes(df: DataFrame) -> int:
    """Size of a plan's result as its statistics have it."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def enrich(df: DataFrame, dimension: DataFrame, on: dict[str, str], *, columns: list[str] | None = None, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """df with columns of the row of dimension whose key matches (on: column of df to column of dimension).

    Rows without a match keep nulls; a key that the dimension has twice repeats the row. A column of a name that df
    has too comes as name_2. The plan's size estimate decides between a broadcast and a shuffle join.
    """
    chosen = columns or [c for c in dimension.columns if c not in on.values()]
    keys, values = [f"_lodeframe_on_{i}" for i in range(len(on))], [f"_lodeframe_value_{i}" for i in range(len(chosen))]
    side = dimension.select(*[dimension[b].alias(k) for b, k in zip(on.values(), keys, strict=True)], *[dimension[c].alias(v) for c, v in zip(chosen, values, strict=True)])
    size = estimated_bytes(side)
    condition = [df[a] == F.col(k) for a, k in zip(on, keys, strict=True)]
    joined = df.join(F.broadcast(side) if size <= most_bytes else side, condition, "left")
    return joined.select(*[df[c] for c in df.columns], *[F.col(v).alias(f"{c}_2" if c in df.columns else c) for c, v in zip(chosen, values, strict=True)])


def lookup(df: DataFrame, key_of: Callable[[dict[str, Any]], Any], fetch: Callable[[Any], Any], merge: Callable[[dict[str, Any], Any], dict[str, Any]], schema: str, *, concurrency: int = 8) -> DataFrame:
    """merge(row, fetch(key_of(row))) for every row, order kept within a partition, up to concurrency calls at once.

    Each distinct key of a batch is fetched once; a null key is not fetched and merges None. The first error ends
    the query.
    """
    if not 1 <= concurrency <= 64:
        raise QueryError("query_limit", "concurrency", "from 1 to 64")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(concurrency) as pool:
            for pdf in batches:
                rows = pdf.astype(object).where(pdf.notna(), None).to_dict("records")
                keys = [key_of(r) for r in rows]
                distinct = [k for k in dict.fromkeys(keys) if k is not None]
                found = dict(zip(distinct, pool.map(fetch, distinct), strict=True))
                yield pd.DataFrame([merge(r, found.get(k)) for r, k in zip(rows, keys, strict=True)])

    return df.mapInPandas(run, schema)


def lookup_pages(pages: Iterable[list[dict[str, Any]]], key_of: Callable[[dict[str, Any]], Any], fetch: Callable[[Any], Any], merge: Callable[[dict[str, Any], Any], dict[str, Any]], *, concurrency: int = 8, on_progress: Callable[[dict[str, int]], None] | None = None) -> Iterator[list[dict[str, Any]]]:
    """Result pages (of at most 1000 rows) enriched one at a time, so that the driver holds one page; order is kept.

    Each distinct key of a page is fetched once, up to concurrency at once; a null key is not fetched and merges None.
    on_progress takes rows_loaded, requests_completed, requests_in_flight and requests_pending, all but the last two
    over all pages so far, after every request. The first error ends the pages; no page, no progress.
    """
    if not 1 <= concurrency <= 64:
        raise QueryError("query_limit", "concurrency", "from 1 to 64")
    loaded = completed = 0
    with ThreadPoolExecutor(concurrency) as pool:
        for page in pages:
            if len(page) > 1000:
                raise QueryError("query_limit", "page", "more than 1000 rows")
            loaded += len(page)
            keys = [key_of(r) for r in page]
            waiting = {pool.submit(fetch, k): k for k in dict.fromkeys(keys) if k is not None}
            found, total = {}, len(waiting)
            try:
                for done in as_completed(waiting):
                    found[waiting[done]] = done.result()
                    completed += 1
                    if on_progress:
                        left = total - len(found)
                        on_progress({"rows_loaded": loaded, "requests_completed": completed, "requests_in_flight": min(left, concurrency), "requests_pending": max(0, left - concurrency)})
            finally:
                for request in waiting:
                    request.cancel()
            yield [merge(r, found.get(k)) for r, k in zip(page, keys, strict=True)]
