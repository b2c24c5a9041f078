"""Row counts, schema listings, column contracts, previews."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows"))


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table_name, n_rows) for several tables; a count reads no column."""
    parts = [row_count(df).select(F.lit(name).alias("table_name"), "n_rows") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def columns_of(spark: SparkSession, df: DataFrame, types: Sequence[str] | None = None) -> DataFrame:
    """(ordinal, column_name, data_type), optionally only some types."""
    rows = [(i + 1, n, t) for i, (n, t) in enumerate(df.dtypes) if types is None or t in types]
    return spark.createDataFrame(rows, "ordinal int, column_name string, data_type string")


def contract_diff(spark: SparkSession, df: DataFrame, expected: Sequence[str]) -> DataFrame:
    """Columns that are missing from, or not part of, an expected list."""
    actual = df.columns
    rows = [(c, "missing") for c in expected if c not in actual]
    rows += [(c, "extra") for c in actual if c not in expected]
    return spark.createDataFrame(rows, "column_name string, status string")


def preview(df: DataFrame, n: int = 2) -> DataFrame:
    return df.limit(n)
