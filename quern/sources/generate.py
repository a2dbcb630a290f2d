"""Synthetic tables, made on the executors and written as comma-separated text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the generated tables.
CATEGORIES = ("A", "B", "C", "D")
REGIONS = ("US", "EU", "ASIA", "AFRICA", "AUSTRALIA", "SOUTH AMERICA")


def _pick(values: tuple[str, ...], seed: int):
    return F.element_at(F.array(*map(F.lit, values)), (F.floor(F.rand(seed) * len(values)) + 1).cast("int"))


def sales(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """id, value (1 to 999), category, region."""
    value = (F.floor(F.rand(seed) * 999) + 1).alias("value")
    return spark.range(n).select("id", value, _pick(CATEGORIES, seed + 1).alias("category"), _pick(REGIONS, seed + 2).alias("region"))


def prices(spark: SparkSession, n: int) -> DataFrame:
    """id, value (ten times id), price (one and a half times id, two decimals), category (id mod 100)."""
    return spark.range(n).select(
        "id",
        (F.col("id") * 10).alias("value"),
        F.format_string("%.2f", F.col("id") * 1.5).alias("price"),
        F.concat(F.lit("cat_"), F.col("id") % 100).alias("category"),
    )


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of text files that each start with the header. Values must not hold commas or line ends."""
    df.write.option("header", True).option("quote", "").option("emptyValue", "").csv(path)
