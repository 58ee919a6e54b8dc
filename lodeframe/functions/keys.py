"""Record keys: collection/id pairs, nested under parents, with escaped ids."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodeframe.errors import QueryError

#: Characters of an id that stand percent-escaped in a path.
ESCAPED = ".$#[]/"


def escape_id(value: str | int | float) -> str:
    text = str(value).replace("%", "%25")
    for c in ESCAPED:
        text = text.replace(c, f"%{ord(c):02X}")
    return text


@dataclass(frozen=True)
class Key:
    collection: str
    id: str | int | float
    parent: Key | None = None

    def __post_init__(self) -> None:
        if not self.collection or "/" in self.collection:
            raise QueryError("key", "collection", "one non-empty segment")
        if isinstance(self.id, bool) or not isinstance(self.id, (str, int, float)) or self.id == "" or self.id != self.id:
            raise QueryError("key", "id", "a non-empty string or a number")

    @property
    def path(self) -> str:
        return f"{self.collection_path}/{escape_id(self.id)}"

    @property
    def collection_path(self) -> str:
        return f"{self.parent.path}/{self.collection}" if self.parent else self.collection

    def child(self, collection: str, id: Any) -> Key:
        return Key(collection, id, self)


def key(collection: str, id: Any, parent: Key | None = None) -> Key:
    return Key(collection, id, parent)


def key_column(collection: str, id: Column, parent: Column | None = None) -> Column:
    """Path of each row's key, as Key.path has it."""
    text = F.regexp_replace(id.cast("string"), "%", "%25")
    for c in ESCAPED:
        text = F.replace(text, F.lit(c), F.lit(f"%{ord(c):02X}"))
    here = F.concat(F.lit(f"{collection}/"), text)
    return here if parent is None else F.concat(parent, F.lit("/"), here)
