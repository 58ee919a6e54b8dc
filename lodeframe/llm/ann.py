"""Nearest neighbours by inner product over randomly rotated one-bit codes.

A vector x is rotated by a fixed random orthogonal matrix and kept as the signs of its coordinates, packed to
bits, with two scalars: its norm and the alignment a = <x', s> / (|x| sqrt(d)) between rotated vector and signs
s. For a query q, <x, q> is estimated by |x| <s, q'> / (a sqrt(d)); the error is at most
|x| |q| sqrt((1 - a^2) / a^2) * eps / sqrt(d - 1) but with a probability that falls as exp(-c eps^2). In every
block of vectors a query keeps those whose upper bound reaches the 20th best lower bound, and ranks them by
the exact inner product in double precision.

Vectors and queries meet block by block: every cell of the grid holds one bounded block of each, so no task
depends on how many there are. All queries are held against all rows, as the search states.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodeframe.llm.common import cut

EPSILON = 3.0
ROWS, QUERIES = 8192, 4096


def rotation(dim: int, seed: int = 20) -> np.ndarray:
    """A random orthogonal matrix, the same for the same arguments."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(x: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits [n, ceil(d / 8)], norms and alignments of the rows of x."""
    y = x @ turn
    norm = np.sqrt((x * x).sum(axis=1))
    align = np.abs(y).sum(axis=1) / (norm * np.sqrt(x.shape[1]))
    return np.packbits(y >= 0, axis=1), norm, align


def bounds(bits: np.ndarray, norm: np.ndarray, align: np.ndarray, queries: np.ndarray, turn: np.ndarray, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products [query, row] and the half-width of their error bounds."""
    dim = queries.shape[1]
    signs = np.unpackbits(bits, axis=1, count=dim).astype(np.float32) * 2 - 1
    estimate = ((queries @ turn).astype(np.float32) @ signs.T) * (norm / (align * np.sqrt(dim))).astype(np.float32)
    error = norm * np.sqrt(np.maximum(1 - align * align, 0)) / align * epsilon / np.sqrt(max(dim - 1, 1))
    length = np.sqrt((queries * queries).sum(axis=1))
    # the float32 product adds a little of its own
    return estimate, (length[:, None] * (error + 1e-5 * norm)).astype(np.float32)


def search_block(vec_id: np.ndarray, x: np.ndarray, codes: tuple[np.ndarray, np.ndarray, np.ndarray], query_id: np.ndarray, q: np.ndarray, k: int, epsilon: float = EPSILON) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """For each query the ids and exact scores of its k best rows of the block, itself left out."""
    turn = rotation(x.shape[1])
    out = []
    for low in range(0, len(q), 256):
        part, ids = q[low : low + 256], query_id[low : low + 256]
        estimate, error = bounds(*codes, part, turn, epsilon)
        own = ids[:, None] == vec_id[None, :]
        lower = np.where(own, -np.inf, estimate - error)
        at = max(0, lower.shape[1] - k)
        floor = np.partition(lower, at, axis=1)[:, at]
        reach = (estimate + error >= floor[:, None]) & ~own
        for i in range(len(part)):
            chosen = np.flatnonzero(reach[i])
            score = (x[chosen] * part[i]).sum(axis=1)
            best = np.lexsort((vec_id[chosen], -score))[:k]
            out.append((int(ids[i]), vec_id[chosen][best], score[best]))
    return out


def usable(vector: Column) -> Column:
    """True for a vector that takes part: not null or empty, no null or non-finite component, not all zero."""
    v = vector.cast("array<double>")
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & fine & F.exists(v, lambda c: c != 0), F.lit(False))


def nearest(vectors: DataFrame, queries: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, epsilon: float = EPSILON, rows: int = ROWS, query_rows: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of queries its k nearest rows of vectors by inner product.

    Rows with the query's own id are no candidates of it. Null ids and vectors that are not usable() take no part;
    vectors of another length than the query's are no candidates. Ties go to the smaller id; repeated rows of an
    id count once, the first in order of the vector. No usable vectors or queries: an empty result.
    """

    def chosen(df: DataFrame, names: tuple[str, str]) -> DataFrame:
        one = df.select(df[id_col].cast("long").alias(names[0]), df[vector_col].cast("array<double>").alias(names[1]))
        one = one.where(F.col(names[0]).isNotNull() & usable(F.col(names[1])))
        return one.groupBy(names[0]).agg(F.min(names[1]).alias(names[1])).withColumn("dim", F.size(names[1]))

    data, asked = cut(chosen(vectors, ("vec_id", "x")), "vectors"), cut(chosen(queries, ("query_id", "q")), "queries")
    n_data, n_asked = max(1, -(-data.count() // rows)), max(1, -(-asked.count() // query_rows))
    left = data.withColumn("d", F.pmod(F.xxhash64("vec_id"), F.lit(n_data)).cast("int")).withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(n_asked - 1))))
    right = asked.withColumn("a", F.pmod(F.xxhash64("query_id"), F.lit(n_asked)).cast("int")).withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(n_data - 1))))

    def cell(block: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        names = {"query_id": "int64", "vec_id": "int64", "score": "float64"}
        if not len(block) or not len(ask):
            return pd.DataFrame({n: pd.Series(dtype=t) for n, t in names.items()})
        x, q = np.stack(block["x"].to_numpy()), np.stack(ask["q"].to_numpy())
        found = search_block(block["vec_id"].to_numpy(), x, encode(x, rotation(x.shape[1])), ask["query_id"].to_numpy(), q, k, epsilon)
        return pd.DataFrame({"query_id": np.repeat([f[0] for f in found], [len(f[1]) for f in found]), "vec_id": np.concatenate([f[1] for f in found]), "score": np.concatenate([f[2] for f in found])}).astype(names)

    met = left.groupBy("dim", "d", "a").cogroup(right.groupBy("dim", "d", "a")).applyInPandas(cell, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def recall(found: DataFrame, truth: DataFrame) -> float:
    """Share of the rows (query_id, vec_id) of truth that found has."""
    keys = ["query_id", "vec_id"]
    hit = truth.select(*keys).distinct().join(found.select(*keys).distinct(), keys, "left_semi").count()
    return hit / max(1, truth.select(*keys).distinct().count())
