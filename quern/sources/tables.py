"""Tables over Parquet files and over any DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.model import Table, normalised
from quern.operators.row_index import numbered, numbered_parquet


def from_parquet(spark: SparkSession, *paths: str) -> Table:
    """A table over Parquet files. A column of another name than the table's stays unread."""
    scan = spark.read.parquet(*paths)
    return Table(normalised(scan), lambda: normalised(numbered_parquet(scan)))


def from_dataframe(df: DataFrame) -> Table:
    """A table over a DataFrame that gives the same rows in the same partitions each time."""
    df = normalised(df)
    return Table(df, lambda: numbered(df))
