"""Codecs between stored and read columns: identity, and JSON text to structs and back."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Codec:
    decode: Callable[[DataFrame], DataFrame]
    encode: Callable[[DataFrame], DataFrame]


def identity_codec() -> Codec:
    return Codec(lambda df: df, lambda df: df)


def json_codec(column: str, schema: str) -> Codec:
    """The column as a struct of the schema when read, as JSON text when stored."""
    return Codec(lambda df: df.withColumn(column, F.from_json(column, schema)), lambda df: df.withColumn(column, F.to_json(column)))
