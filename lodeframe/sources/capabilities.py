"""What the engine and its sources can do, as a plain dict; nothing is probed."""

from __future__ import annotations

from typing import Any

from lodeframe.errors import UnsupportedError


def capabilities() -> dict[str, bool]:
    return {"query": True, "joins": True, "subqueries": True, "aggregates": True, "cursors": True, "money": True, "text": True, "lookups": True, "insert": True, "set": True, "update": True, "delete": True, "transactions": False, "window_functions": False, "set_operations": False, "user_functions": False}


def is_capability_aware(x: Any) -> bool:
    return callable(getattr(x, "capabilities", None))


def is_resettable(x: Any) -> bool:
    return callable(getattr(x, "reset", None))


def require(name: str, source: Any = None) -> None:
    known = source.capabilities() if is_capability_aware(source) else capabilities()
    if not known.get(name):
        raise UnsupportedError(name)
