"""0-based row positions without a global sort.

monotonically_increasing_id is (partition << 33) + position in the partition, so the position in
the whole is that plus the number of rows in earlier partitions. The numbers of rows by
partition, or by file, are all that reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.model import ROW_INDEX

_SHIFT, _ID, _PART, _BASE = 33, "__row_id", "__row_part", "__row_base"


def _with_base(df: DataFrame, part: Column, local: Column, counts: list[tuple], kind: str, name: str) -> DataFrame:
    """Adds local + the sum of the counts of the parts before it. counts: (part, rows), in order."""
    if len(counts) < 2:
        return df.withColumn(name, local)
    at, rows = 0, []
    for key, n in counts:
        rows.append((key, at))
        at += n
    base = df.sparkSession.createDataFrame(rows, f"{_PART} {kind}, {_BASE} bigint")
    # one row for each partition or file; Spark broadcasts it while it is small
    out = df.withColumn(_PART, part).withColumn(name, local)
    return out.join(base, _PART).withColumn(name, F.col(name) + F.col(_BASE)).drop(_PART, _BASE)


def numbered(df: DataFrame, name: str = ROW_INDEX) -> DataFrame:
    """df with each row's position. df must give the same rows in the same partitions again."""
    ids = df.withColumn(_ID, F.monotonically_increasing_id())
    part = F.shiftright(_ID, _SHIFT)
    counts = ids.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()
    local = F.col(_ID).bitwiseAND((1 << _SHIFT) - 1)
    return _with_base(ids, part, local, sorted(map(tuple, counts)), "bigint", name).drop(_ID)


def numbered_parquet(df: DataFrame, name: str = ROW_INDEX) -> DataFrame:
    """A scan of Parquet files with each row's position, files in the order of their paths."""
    columns = [F.col("`" + f.name.replace("`", "``") + "`") for f in df.schema.fields]
    local = F.col("_metadata.row_index").cast(T.LongType())
    if len(df.inputFiles()) < 2:
        return df.select(*columns, local.alias(name))
    files = df.select(F.col("_metadata.file_path").alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("n")).collect()
    scan = df.select(*columns, local.alias(_ID), F.col("_metadata.file_path").alias("__row_file"))
    return _with_base(scan, F.col("__row_file"), F.col(_ID), sorted(map(tuple, files)), "string", name).drop(_ID, "__row_file")
