"""Turning one wide aggregate row into a long table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def long_form(wide: DataFrame, rows: Mapping[str, Mapping[str, Column]], key: str) -> DataFrame:
    """One output row per entry of ``rows``; all entries need the same fields and types."""
    items = [
        F.struct(F.lit(name).alias(key), *[c.alias(f) for f, c in cols.items()]) for name, cols in rows.items()
    ]
    fields = list(next(iter(rows.values())))
    return wide.select(F.explode(F.array(*items)).alias("x")).select(f"x.{key}", *[f"x.{f}" for f in fields])
