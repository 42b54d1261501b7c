"""Cosine similarity over array columns, in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """Similarity in double precision; null for null, zero, NaN or differently long vectors."""
    x, y = doubles(a), doubles(b)
    s = F.try_divide(dot(x, y), norm(x) * norm(y))
    return F.when((F.size(x) == F.size(y)) & ~F.isnan(s), s)


def query_vector(values: Sequence[float]) -> Column:
    """A literal vector; it is folded into the plan."""
    return F.array(*[F.lit(float(x)) for x in values])
