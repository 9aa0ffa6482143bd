"""Columns for JSON texts and nested values."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def length(json: Column) -> Column:
    """Elements of a JSON array; null for broken text."""
    return F.json_array_length(json)


def field(json: Column, path: str) -> Column:
    """The value at ``$.path`` as text; null for missing values and broken text."""
    return F.get_json_object(json, f"$.{path}")


def contains(values: Column, item: Column | object) -> Column:
    """Whether an array holds ``item``; false for null."""
    return F.coalesce(F.array_contains(values, item), F.lit(False))


def encode(columns: Mapping[str, Column]) -> Column:
    """A JSON object; NaN becomes null and nulls are kept."""
    clean = [F.when(F.isnan(c.cast("double")), None).otherwise(c).alias(k) if k.startswith("num_") else c.alias(k) for k, c in columns.items()]
    return F.to_json(F.struct(*clean), {"ignoreNullFields": "false"})


def nan_to_null(column: Column) -> Column:
    return F.nanvl(column, F.lit(None).cast("double"))
