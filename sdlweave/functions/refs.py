"""Expressions over type references such as ``[Order!]!``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def base_type(ref: Column) -> Column:
    """The named type of a reference: ``[``, ``]`` and ``!`` removed, white space around it trimmed."""
    return F.regexp_replace(F.translate(ref, "[]!", ""), r"(?U)^\s+|\s+$", "")


def required_arguments(arguments: Column) -> Column:
    """Arguments whose type ends with ``!``; a default value does not exempt."""
    return F.filter(arguments, lambda a: F.endswith(F.trim(a["type"]), F.lit("!")))
