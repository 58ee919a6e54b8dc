"""A corpus in five stages: quality classifier, SimHash near-dedup, substring dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; run() writes each result as
Parquet in the shared folder and reads it again for the next.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodeframe.llm import mixing, packing, quality, simhash, substring
from lodeframe.llm.common import cut, small_batches
from lodeframe.llm.registry import tokenizer_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the Kneser-Ney classifier rejects go."""
    small_batches(spark)
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five-word shingles, a similarity of 0.8 or more."""
    small_batches(spark)
    return simhash.one_of_each(docs, simhash.near_duplicates(docs, width=5, similarity=0.8))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut out of the later ones."""
    small_batches(spark)
    return substring.without_passages(docs, substring.repeated_passages(docs))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document once for each place on the training line, in that order."""
    return mixing.training_order(docs, mixing.curriculum(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences of 2048."""
    small_batches(spark)
    return packing.pack(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("simhash", simhash_stage),
    ("substring", substring_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: The stages hold models, chains and tokens that SQL cannot express; tests hold them against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
