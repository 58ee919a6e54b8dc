"""Governance of sources: rights notes, read plans with digests, and composition of admitted leaves.

Everything here is metadata beside a query; rows are never looked at.
"""

from __future__ import annotations

import copy
import hashlib
import json
import math
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

from lodeframe.errors import QueryError, UnsupportedError
from lodeframe.plans.document import Query
from lodeframe.sources.catalog import Catalog

MAX_LEAVES, MAX_BYTES = 64, 256 * 1024


def snapshot(metadata: Any, path: str = "metadata") -> Any:
    """A detached copy of plain metadata: strings, finite numbers, booleans, nulls, lists and mappings."""
    if metadata is None or isinstance(metadata, (bool, str, int)):
        return metadata
    if isinstance(metadata, float):
        if not math.isfinite(metadata):
            raise QueryError("metadata", path, "not finite")
        return metadata
    if isinstance(metadata, Mapping):
        if not all(isinstance(k, str) for k in metadata):
            raise QueryError("metadata", path, "keys are strings")
        return {k: snapshot(v, f"{path}.{k}") for k, v in metadata.items()}
    if isinstance(metadata, (list, tuple)):
        return [snapshot(v, f"{path}[{i}]") for i, v in enumerate(metadata)]
    raise QueryError("metadata", path, f"no plain value: {type(metadata).__name__}")


def number_text(v: int | float) -> str:
    """A number as ECMAScript prints it, as canonical JSON asks."""
    if v == 0:
        return "0"
    if isinstance(v, int) and abs(v) < 10**21:
        return str(v)
    shortest = repr(float(v))
    mantissa, _, e = shortest.partition("e")
    sign, mantissa = ("-", mantissa[1:]) if mantissa.startswith("-") else ("", mantissa)
    whole, _, part = mantissa.partition(".")
    part = "" if part == "0" else part
    point = len(whole) + int(e or 0)
    text = (whole + part).lstrip("0")
    point -= len(whole + part) - len(text)
    text = text.rstrip("0") or "0"
    n = len(text)
    if n <= point <= 21:
        return sign + text + "0" * (point - n)
    if 0 < point <= 21:
        return f"{sign}{text[:point]}.{text[point:]}"
    if -6 < point <= 0:
        return f"{sign}0.{'0' * -point}{text}"
    shown = text if n == 1 else f"{text[0]}.{text[1:]}"
    return f"{sign}{shown}e{'+' if point > 0 else '-'}{abs(point - 1)}"


def canonical_json(x: Any) -> str:
    """JSON with keys in UTF-16 order, no spaces and ECMAScript numbers (RFC 8785)."""
    if x is None or isinstance(x, bool):
        return json.dumps(x)
    if isinstance(x, (int, float)):
        if not math.isfinite(x):
            raise QueryError("evidence", "value", "not finite")
        return number_text(x)
    if isinstance(x, str):
        return json.dumps(x, ensure_ascii=False)
    if isinstance(x, Mapping):
        return "{" + ",".join(f"{canonical_json(k)}:{canonical_json(x[k])}" for k in sorted(x, key=lambda k: k.encode("utf-16-be"))) + "}"
    return "[" + ",".join(canonical_json(v) for v in x) + "]"


def digest(x: Any) -> str:
    return "sha256:" + hashlib.sha256(canonical_json(x).encode()).hexdigest()


# --- declarations -------------------------------------------------------------------------------------------


def bounded_text(v: Any, path: str, most: int = 256) -> str:
    if not isinstance(v, str) or not v.strip() or len(v) > most or any(ord(c) < 32 for c in v):
        raise QueryError("declaration", path, f"text of 1 to {most} characters")
    return v


def https_url(v: Any, path: str) -> str:
    bounded_text(v, path, 2048)
    if not re.fullmatch(r"https://[A-Za-z0-9.-]+(:\d+)?(/[^\s]*)?", v):
        raise QueryError("declaration", path, "an https URL without credentials")
    return v


def pin(v: Any, path: str) -> str:
    if not isinstance(v, str) or not re.fullmatch(r"sha256:[0-9a-f]{64}", v):
        raise QueryError("declaration", path, "sha256: and 64 hex digits")
    return v


@dataclass(frozen=True)
class Rights:
    """Rights of one source: who declared them, under what license, and where it can be read."""

    source: str
    license: str
    url: str
    attribution: str = ""

    def checked(self) -> Rights:
        bounded_text(self.source, "rights.source")
        bounded_text(self.license, "rights.license")
        https_url(self.url, "rights.url")
        return self

    def as_dict(self) -> dict[str, Any]:
        return {"source": self.source, "license": self.license, "url": self.url, "attribution": self.attribution}


def require_unannotated(catalog: Catalog, relation: Mapping[str, Any]) -> None:
    if catalog.find(relation).rights is not None:
        raise UnsupportedError("source-rights-preflight")


# --- read plans ---------------------------------------------------------------------------------------------


def read_plan(reads: list[Mapping[str, Any]]) -> dict[str, Any]:
    """A plan of provider reads, checked and sealed with a digest over its canonical JSON."""
    if not reads or len(reads) > MAX_LEAVES:
        raise QueryError("provider_reads", "reads", f"from 1 to {MAX_LEAVES}")
    plain = []
    for i, r in enumerate(snapshot(reads)):
        for k in ("provider", "resource"):
            bounded_text(r.get(k), f"reads[{i}].{k}")
        if "evidence" in r:
            pin(r["evidence"], f"reads[{i}].evidence")
        if set(r) - {"provider", "resource", "evidence", "fields"}:
            raise QueryError("provider_reads", f"reads[{i}]", "unknown key")
        plain.append(r)
    return {"version": 1, "reads": plain, "digest": digest(plain)}


def validate_read_plan(plan: Mapping[str, Any]) -> None:
    if set(plan) != {"version", "reads", "digest"} or plan["version"] != 1:
        raise QueryError("provider_reads", "plan", "version 1 with reads and digest")
    if read_plan(plan["reads"])["digest"] != plan["digest"]:
        raise QueryError("provider_reads", "digest", "does not match the reads")


# --- composition --------------------------------------------------------------------------------------------


@dataclass
class Composed:
    """A governed join's rows and the envelope of all leaves that went into it."""

    frame: DataFrame
    envelope: dict[str, Any] = field(default_factory=dict)


def leaves(relation: Mapping[str, Any]) -> list[Mapping[str, Any]]:
    out = [relation]
    for j in relation.get("joins") or ():
        out += leaves(j["from"])
    return out


def composed_frame(catalog: Catalog, query: Query, admit: Callable[[Mapping[str, Any], Mapping[str, Any] | None], Mapping[str, Any]]) -> Composed:
    """A J query over annotated sources: every leaf is admitted before anything is read.

    admit(leaf, rights) gives the leaf's admission or raises. Scans, money and derived tables are refused.
    """
    from lodeframe.plans.run import to_frame

    if query.dialect != "J" or query.body.get("money"):
        raise UnsupportedError("source-composition-query")
    found = leaves(query.body["from"])
    if len(found) > MAX_LEAVES:
        raise QueryError("source_composition", "from", f"more than {MAX_LEAVES} inputs")
    if any("scan" in r for r in found):
        raise UnsupportedError("source-composition-scan")
    admitted = []
    for r in found:
        rights = catalog.find(r).rights
        admitted.append({"alias": r.get("alias", r["name"]), "name": r["name"], "rights": snapshot(rights), "admission": snapshot(admit(r, copy.deepcopy(rights)))})
    envelope = {"version": 1, "inputs": admitted}
    if len(canonical_json(envelope).encode()) > MAX_BYTES:
        raise QueryError("source_composition", "metadata", f"more than {MAX_BYTES} bytes")
    return Composed(to_frame(catalog, query, governed=True), {**envelope, "digest": digest(envelope)})
