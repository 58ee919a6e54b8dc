"""The catalog: named databases of DataFrames, with field classes, authorisation, relationships and rights."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from lodeframe.errors import NotFoundError

#: Classes of values, in the order in which values of different classes compare.
RANKS = {"list": 0, "bool": 1, "number": 2, "string": 3, "other": 4, "time": 4}

MIXED = T.StructType([T.StructField("r", T.ByteType()), T.StructField("n", T.DoubleType()), T.StructField("s", T.StringType())])


def class_of(kind: T.DataType) -> str:
    """null, bool, number, string, time, list, mixed or other."""
    if kind == MIXED:
        return "mixed"
    if isinstance(kind, T.NullType):
        return "null"
    if isinstance(kind, T.BooleanType):
        return "bool"
    if isinstance(kind, T.NumericType):
        return "number"
    if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
        return "string"
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "time"
    return "list" if isinstance(kind, T.ArrayType) else "other"


def mixed_value(value: Any) -> tuple[int, float | None, str | None] | None:
    """A scalar as the struct that mixed columns hold: rank, number, string. Structs compare as the values do."""
    if value is None:
        return None
    if isinstance(value, bool):
        return (1, float(value), None)
    if isinstance(value, (int, float)):
        return (2, float(value), None)
    return (3, None, str(value))


def plain_value(value: Any) -> Any:
    """The scalar that a mixed struct stands for."""
    if value is None or not hasattr(value, "asDict"):
        return value
    rank, number, text = value["r"], value["n"], value["s"]
    return bool(number) if rank == 1 else text if rank == 3 else number


@dataclass(frozen=True)
class Relationship:
    """A declared link between two tables: field pairs that a join without conditions uses."""

    id: str
    left: str
    right: str
    pairs: tuple[tuple[str, str], ...]
    version: str = "1"
    exact_types: bool = True


@dataclass
class Table:
    frame: Callable[[], DataFrame]
    authorized: tuple[str, ...] | None = None
    types: Mapping[str, str] = field(default_factory=dict)
    rights: Mapping[str, Any] | None = None

    def open(self) -> DataFrame:
        df = self.frame()
        return df if self.authorized is None else df.select(*self.authorized)


class Catalog:
    """(database, schema, name) to tables. A relation without database or schema finds the default one.

    resolver: asked for relations that are not here; gives a DataFrame, or None where it has none either.
    """

    def __init__(self, spark: SparkSession, resolver: Callable[[Mapping[str, Any]], DataFrame | None] | None = None):
        self.spark, self.resolver = spark, resolver
        self.tables: dict[tuple[str | None, str | None, str], Table] = {}
        self.relationships: list[Relationship] = []

    def add(self, name: str, source: DataFrame | Callable[[], DataFrame], *, database: str | None = None, schema: str | None = None, authorized: Iterable[str] | None = None, types: Mapping[str, str] | None = None, rights: Mapping[str, Any] | None = None) -> Catalog:
        frame = source if callable(source) and not isinstance(source, DataFrame) else (lambda: source)
        self.tables[database, schema, name] = Table(frame, tuple(authorized) if authorized is not None else None, types or {}, rights)
        return self

    def add_parquet(self, folder: str, names: Iterable[str], **where: Any) -> Catalog:
        for name in names:
            self.add(name, lambda name=name: self.spark.read.parquet(f"{folder}/{name}.parquet"), **where)
        return self

    def add_rows(self, name: str, rows: Sequence[Mapping[str, Any]], fields: Sequence[str] | None = None, **where: Any) -> Catalog:
        """Rows given in Python: a field whose values mix classes becomes a mixed column."""
        fields = list(fields or dict.fromkeys(k for r in rows for k in r))
        kinds: dict[str, T.DataType] = {}
        for f in fields:
            values = [r.get(f) for r in rows if r.get(f) is not None]
            classes = {"bool" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "string" if isinstance(v, str) else "other" for v in values}
            if len(classes) > 1:
                kinds[f] = MIXED
            elif classes == {"bool"}:
                kinds[f] = T.BooleanType()
            elif classes == {"number"}:
                kinds[f] = T.LongType() if all(isinstance(v, int) and abs(v) < 1 << 53 for v in values) else T.DoubleType()
            else:
                kinds[f] = T.StringType()
        kind = T.StructType([T.StructField(f, k) for f, k in kinds.items()])
        one = lambda f, v: None if v is None else mixed_value(v) if kinds[f] == MIXED else float(v) if isinstance(kinds[f], T.DoubleType) else v
        data = [tuple(one(f, r.get(f)) for f in fields) for r in rows]
        return self.add(name, lambda: self.spark.createDataFrame(data, kind), **where)

    def add_relationship(self, relationship: Relationship) -> Catalog:
        self.relationships.append(relationship)
        return self

    def find(self, relation: Mapping[str, Any]) -> Table:
        key = (relation.get("database"), relation.get("schema"), relation["name"])
        found = self.tables.get(key) or (self.tables.get((key[0], None, key[2])) if key[1] is None else None)
        if found is None and self.resolver is not None:
            df = self.resolver(relation)
            found = None if df is None else Table(lambda: df)
        if found is None:
            raise NotFoundError(".".join(str(k) for k in key if k) + " is not in the catalog")
        return found

    def fields(self, relation: Mapping[str, Any]) -> list[str]:
        return self.find(relation).open().columns

    def databases(self) -> list[str]:
        return sorted({d for d, _, _ in self.tables if d})
