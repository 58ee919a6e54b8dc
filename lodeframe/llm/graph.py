"""Connected components by alternating large-star and small-star rounds, all on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeframe.llm.common import cut


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("m", "u").alias("m"))
    joined = both.where("v > u").join(least, F.col("u") == F.col("w"))
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
    joined = down.join(least, F.col("u") == F.col("w"))
    to_least = joined.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return to_least.unionAll(least.select(F.col("w").alias("u"), F.col("m").alias("v"))).distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """From links (u, v), longs: (node, root) for every node with a link, root the least node it reaches.

    Links from a node to itself and nulls are ignored; no links give an empty table. Each round is written to
    the shared folder, so a lost executor costs one round at most.
    """
    edges = cut(links.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v").distinct(), "links")
    state = None
    for _ in range(most_rounds):
        seen = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if seen["n"] == 0 or (state is not None and tuple(seen) == state):
            least = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return least.unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        state = tuple(seen)
        edges = cut(_small_star(_large_star(edges)), "links")
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
