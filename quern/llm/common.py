"""What the corpus operators share: tables, scratch storage, Arrow rows and word runs."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows and bytes of an Arrow batch where the session has Spark's default. By that, ten thousand whole texts
#: go to Python at once, and the JVM holds a few times as much outside of its heap.
ROWS, ROWS_AT_ONCE = "10000", "1000"
BYTES_AT_ONCE = str(4 << 20)


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once for each Spark context, and bound the session's Arrow batches."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS_AT_ONCE)
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BYTES_AT_ONCE)
    sc = spark.sparkContext
    if getattr(sc, "_quern_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="quern-"), "quern.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for folder, _, files in os.walk(root):
            for file in files:
                if file.endswith(".py"):
                    full = os.path.join(folder, file)
                    archive.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(target)
    sc._quern_shipped = True


#: Rows that Spark's default lets its Parquet reader decode at once, and those that do for whole texts.
READ, READ_AT_ONCE = "4096", "128"


@contextmanager
def few_rows_read_at_once(spark: SparkSession) -> Iterator[None]:
    """For jobs run meanwhile that shuffle texts straight from Parquet: by Spark's default, thousands of whole texts are
    decoded into one array, which doubles until they fit, and executors' heaps grow by such arrays and keep the memory."""
    name = "spark.sql.parquet.columnarReaderBatchSize"
    if spark.conf.get(name) != READ:
        yield
        return
    spark.conf.set(name, READ_AT_ONCE)
    try:
        yield
    finally:
        spark.conf.unset(name)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that spark.checkpoint.dir names; it goes when the driver ends.

    Only a session on one machine (local mode) can do without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = os.path.join(tempfile.gettempdir(), "quern-checkpoints")
    path = f"{base.rstrip('/')}/quern-{name}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df to the shared folder and read it again: later jobs start from files, so a lost
    executor costs no recomputation, and the plan behind df runs once. options: of the Parquet writer."""
    path = scratch(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


#: Bytes of input for each partition of a shuffle that Spark's own setting would make too few of.
PARTITION_BYTES = 64 << 20


def _size(df: DataFrame) -> int:
    """Bytes that Spark expects; from 2**60 on they are unknown."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(df: DataFrame) -> DataFrame:
    """A small input of fewer files than cores, dealt out to all cores: a file of one row group would
    else be read, and worked on, by one task. Larger inputs stay as they lie."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if _size(df) < cores * PARTITION_BYTES // 2 and 0 < len(df.inputFiles()) < cores else df


def parts(df: DataFrame, times: float = 1.0) -> list[int]:
    """How many partitions to deal df to, if its size times `times` asks for more than the session's
    setting; else (and where the size is unknown) nothing, and Spark joins small ones as it likes."""
    size = _size(df)
    wanted = int(-(-size * times // PARTITION_BYTES)) if size < 1 << 60 else 0
    return [wanted] if wanted > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else []


#: A key is hot from this share of the rows on, so there are fewer hot keys than HOT; tables of fewer
#: bytes than SMALL are not looked through, as no key of theirs can hold up a task.
HOT, SMALL = 1000, 8 << 20


def hot_keys(df: DataFrame, on: str) -> DataFrame | None:
    """The hot values of a column of a stored table, fewer than HOT; None if there are none."""
    if _size(df) <= SMALL:
        return None
    least = df.count() / HOT
    hot = stored(df.groupBy(on).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > least).select(on), "hot")
    return None if hot.isEmpty() else hot


def hot_join(left: DataFrame, right: DataFrame, on: str, hot: DataFrame | None) -> DataFrame:
    """The rows of left with those of right, which has each value of `on` once.

    What right holds for hot keys, fewer than HOT rows, is broadcast, and their rows are joined where they
    lie; the other rows are left to Spark's choice."""
    if hot is None:
        return left.join(right, on)
    here = left.join(F.broadcast(right.join(F.broadcast(hot), on, "left_semi")), on)
    return here.unionByName(left.join(F.broadcast(hot), on, "left_anti").join(right, on))


def row_numbers(first: int, n: int) -> pa.Array:
    """Numbers of rows of a task, which no other row of the job has; the same ones if the task runs again."""
    return pa.array(np.arange(first, first + n) + (TaskContext.get().partitionId() << 33))


def byte_rows(column: pa.Array, null: bytes = b"") -> Iterator[bytes]:
    """The UTF-8 bytes of each value of a string or binary column."""
    for value in column.cast(pa.large_binary()):
        got = value.as_buffer()
        yield null if got is None else got.to_pybytes()


def slices(batch: pa.RecordBatch, column: int, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of each part hold about `limit` bytes (one row at least)."""
    n, start, size = batch.num_rows, 0, 0
    lengths = np.diff(_offsets(batch.column(column)))
    if not n or lengths.sum() <= limit:
        if n:
            yield batch
        return
    for i in range(n):
        if size and size + lengths[i] > limit:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += lengths[i]
    yield batch.slice(start, n - start)


def _offsets(column: pa.Array) -> np.ndarray:
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    raw = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    return raw[column.offset : column.offset + len(column) + 1].astype(np.int64)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of arange(start, start + length) for each pair."""
    total = int(lengths.sum())
    shift = starts - np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(lengths) else starts
    return np.repeat(shift, lengths) + np.arange(total, dtype=np.int64)


LETTER = re.compile(r"[^\W\d_]")

#: Values that a worker remembers before it forgets the older ones.
MEMORY = 250_000
#: Characters of a text that is remembered.
LONGEST = 64


class Memo(dict):
    """Values by key, made when first asked for. Of more than `limit` keys, those go that have not
    been asked for since the last time. Texts of more than LONGEST characters are made each time."""

    def __init__(self, make, limit: int = MEMORY):
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if not isinstance(key, str) or len(key) <= LONGEST:
            self[key] = value
        return value
