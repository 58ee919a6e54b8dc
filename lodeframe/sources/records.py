"""Records by key: point reads and multi-gets, inserts, sets, updates and deletes over tables with a _key column.

Writes give the new table as a DataFrame; save() writes it. Plain files have no transactions, so those are refused.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeframe.errors import AlreadyExistsError, NotFoundError, UnsupportedError
from lodeframe.functions.keys import Key, key_column


def keyed(df: DataFrame, collection: str, id_col: str, parent: Column | None = None) -> DataFrame:
    """df with the key of each row, and the parent's path where there is one."""
    out = df.withColumn("_key", key_column(collection, F.col(id_col), parent))
    return out if parent is None else out.withColumn("_parent_path", parent)


class Session:
    """Reads and writes of one keyed table."""

    def __init__(self, df: DataFrame):
        self.df = df

    def get(self, k: Key) -> dict[str, Any] | None:
        row = self.df.where(F.col("_key") == k.path).head()
        return row.asDict() if row else None

    def require(self, k: Key) -> dict[str, Any]:
        found = self.get(k)
        if found is None:
            raise NotFoundError(k.path)
        return found

    def get_many(self, keys: Iterable[Key]) -> DataFrame:
        """One row for each key in the order asked (_at); records that are missing have nulls and _exists false."""
        asked = self.df.sparkSession.createDataFrame([(i, k.path) for i, k in enumerate(keys)], "_at long, _asked string")
        joined = asked.join(self.df, F.col("_asked") == F.col("_key"), "left")
        return joined.withColumn("_exists", F.col("_key").isNotNull()).drop("_key").withColumnRenamed("_asked", "_key").orderBy("_at")

    def _same_keys(self, rows: DataFrame) -> DataFrame:
        return rows.select("_key").join(self.df.select("_key"), "_key", "left_semi")

    def _once(self, rows: DataFrame) -> None:
        again = rows.groupBy("_key").count().where("count > 1").head()
        if again:
            raise AlreadyExistsError(again["_key"])

    def insert(self, rows: DataFrame) -> Session:
        """Adds rows; a key that is there already, or twice among the rows, is an error."""
        self._once(rows)
        taken = self._same_keys(rows).head()
        if taken:
            raise AlreadyExistsError(taken["_key"])
        return Session(self.df.unionByName(rows, allowMissingColumns=True))

    def set(self, rows: DataFrame) -> Session:
        """Rows replace those with their keys; others are added. A key twice among the rows is an error."""
        self._once(rows)
        kept = self.df.join(rows.select("_key").distinct(), "_key", "left_anti").select(*self.df.columns)
        return Session(kept.unionByName(rows, allowMissingColumns=True))

    def update(self, k: Key, changes: Mapping[str, Any]) -> Session:
        self.require(k)
        hit = F.col("_key") == k.path
        return Session(self.df.withColumns({c: F.when(hit, F.lit(v)).otherwise(F.col(f"`{c}`")) for c, v in changes.items()}))

    def delete(self, keys: Iterable[Key]) -> Session:
        return Session(self.df.where(~F.col("_key").isin(*[k.path for k in keys]) | F.col("_key").isNull()))

    def save(self, path: str, mode: str = "errorifexists") -> None:
        self.df.write.mode(mode).parquet(path)

    def transaction(self) -> None:
        raise UnsupportedError("plain Parquet has no transactions")
