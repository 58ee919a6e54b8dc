"""Errors: `category at path: reason` for queries, and the kinds that sessions raise."""

from __future__ import annotations


class LodeError(Exception):
    """Base of all errors raised here."""


class QueryError(LodeError):
    def __init__(self, code: str, path: str, reason: str):
        super().__init__(f"{code} at {path}: {reason}")
        self.code, self.path, self.reason = code, path, reason


class NotFoundError(LodeError):
    pass


class AlreadyExistsError(LodeError):
    pass


class UnsupportedError(LodeError):
    pass
