"""Stage tables, dataset exports and JSON reports."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> DataFrame:
    """Replace a Parquet table and return it read back: later steps start from the files."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.parquet(path)


def replace_partitions(df: DataFrame, path: str, keys: list[str]) -> None:
    """Append by key: the partitions that ``df`` holds are replaced, all others stay, so a repeated run leaves the same table."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def append_table(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def save_bucketed(df: DataFrame, name: str, key: str, buckets: int) -> None:
    """Catalog table bucketed and sorted on ``key`` so that later joins on it skip the shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(name)


def write_csv(df: DataFrame, path: str, order_by: str = "stay_id") -> None:
    """Dataset as CSV part files with a header, globally ordered by range partitioning."""
    df.orderBy(order_by).write.mode("overwrite").option("header", True).csv(path)


def write_report(reports: Mapping[str, DataFrame], path: str) -> None:
    """One JSON directory per report table."""
    for name, df in reports.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def add_column(df: DataFrame, path: str, name: str, value: Column) -> DataFrame:
    """Stored table plus one derived column, written to a new path."""
    return write_table(df.withColumn(name, value), path)
