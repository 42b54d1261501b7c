"""Filter predicates on columns and metadata, joined by AND."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

_IDENTIFIER = re.compile(r"[a-zA-Z0-9_]+")
OPERATORS = ("eq", "neq", "in", "exists")


@dataclass(frozen=True)
class MetadataFilter:
    """``field`` of the metadata against ``value``; ``op`` is eq, neq, in or exists."""

    field: str
    op: str
    value: Any = None


@dataclass(frozen=True)
class ColumnFilter:
    """``column`` is name or type; ``op`` is eq or in."""

    column: str
    op: str
    value: Any = None


def guard(identifier: str) -> str:
    if not _IDENTIFIER.fullmatch(identifier):
        raise ValueError(f"not an identifier: {identifier!r}")
    return identifier


def text_of(value: Any) -> str:
    """A value as the text that a JSON field extraction gives."""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float) and value.is_integer():
        return str(int(value))
    return str(value)


def _metadata(f: MetadataFilter, source: str, as_json: bool) -> Column:
    name = guard(f.field)
    field = F.get_json_object(F.col(source), f"$.{name}") if as_json else F.col(f"{source}.{name}").cast("string")
    if f.op == "eq":
        return field == text_of(f.value)
    if f.op == "neq":  # rows that lack the field are excluded
        return field != text_of(f.value)
    if f.op == "in":
        return field.isin(*[text_of(v) for v in f.value]) if f.value else F.lit(False)
    if f.op == "exists":
        return F.coalesce(F.array_contains(F.json_object_keys(F.col(source)), name), F.lit(False)) if as_json else F.col(f"{source}.{name}").isNotNull()
    raise ValueError(f"unknown operator: {f.op}")


def _column(f: ColumnFilter) -> Column:
    column = F.col(guard(f.column))
    if f.op == "eq":
        return column == f.value
    if f.op == "in":
        return column.isin(*f.value) if f.value else F.lit(False)
    raise ValueError(f"unknown operator: {f.op}")


def condition(metadata: Iterable[MetadataFilter] = (), columns: Iterable[ColumnFilter] = (), source: str = "metadata", as_json: bool = False) -> Column | None:
    """All filters joined by AND; None without filters. Struct fields reach the Parquet scan, JSON text does not."""
    parts = [_metadata(f, source, as_json) for f in metadata] + [_column(f) for f in columns]
    return reduce(and_, parts) if parts else None


def apply(df, metadata: Iterable[MetadataFilter] = (), columns: Iterable[ColumnFilter] = (), source: str = "metadata", as_json: bool = False):
    c = condition(metadata, columns, source, as_json)
    return df if c is None else df.filter(c)
