"""Streams of facts against bounded dimensions: the stateless join that paged plans use, on Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lodeframe.operators.lookup import enrich
from lodeframe.plans.run import pages


def stream_parquet(spark: SparkSession, folder: str, like: DataFrame, files_per_trigger: int = 1) -> DataFrame:
    """New Parquet files of a folder as a stream, with the schema of like."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def stream_enriched(facts: DataFrame, dimension: DataFrame, on: dict[str, str]) -> DataFrame:
    """Each fact with its dimension row: a stream-static join, without state or watermark."""
    return enrich(facts, dimension, on)


def to_memory(df: DataFrame, name: str, mode: str = "append") -> StreamingQuery:
    return df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()


def result_pages(df: DataFrame, size: int = 500) -> Iterator[list[dict[str, Any]]]:
    """Pages of a batch result; the consumer's pace bounds what is held."""
    return pages(df, size)
