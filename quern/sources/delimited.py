"""Comma-separated text: three types inferred from the first data row, and a report of bad input.

There is no quoting: each comma parts two fields. Lines end in LF, with at most one CR before it.
Spark's CSV reader can't keep empty fields apart from NULL or drop rows of the wrong width, so lines are
split here; the whole parse is one projection over a splittable text scan.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cached_property

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.errors import LoadError
from quern.model import ColType, Table
from quern.operators.row_index import numbered

#: What counts as a number. \z, since $ also matches before a last line end.
INT = r"^-?[0-9]+\z"
FLOAT = r"(?i)^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?|inf|infinity|nan)\z"


#: Lines that are looked at for a header and a first data row before all lines are.
PEEK = 64


def infer(value: str) -> ColType:
    """bigint if the text is a whole number of 64 bits, else double if it is a number, else string."""
    if re.match(INT.replace(r"\z", r"\Z"), value) and -(1 << 63) <= int(value) < 1 << 63:
        return ColType.INT
    return ColType.FLOAT if re.match(FLOAT.replace(r"\z", r"\Z"), value) else ColType.STR


@dataclass(frozen=True)
class LoadReport:
    """What was wrong in a file; nothing is computed before it is asked for."""

    table: Table
    lines: DataFrame
    names: list[str]
    types: list[ColType]

    @property
    def rows_processed(self) -> int:
        return self.table.row_count()

    @cached_property
    def errors(self) -> DataFrame:
        """row (line number, the first line's is 1), column, value, error: a row for each line of the
        wrong width (column "", error NULL) and for each cell that is no number of its column's type."""
        data = numbered(self.lines, "row").filter(_is_data()).select((F.col("row") + 1).alias("row"), _split())
        width = len(self.names)
        wrong_width = F.struct(
            F.lit("").alias("column"),
            F.format_string(f"Expected {width} fields, got %d", F.size("f")).alias("value"),
            F.lit(None).cast("string").alias("error"),
        )
        no_number = [
            F.when(
                _typed(_cell(k, width), kind).isNull(),
                F.struct(F.lit(name).alias("column"), _cell(k, width).alias("value"), F.lit(f"not a {kind.value}").alias("error")),
            )
            for k, (name, kind) in enumerate(zip(self.names, self.types))
            if kind is not ColType.STR
        ]
        bad = F.filter(F.array(*no_number), lambda x: x.isNotNull()) if no_number else F.lit(None)
        found = F.when(F.size("f") != width, F.array(wrong_width)).otherwise(bad)
        return data.select("row", F.explode(found).alias("e")).select("row", "e.column", "e.value", "e.error")


def _is_data() -> Column:
    return ~F.col("is_header") & ~F.col("value").isin("", "\r")


def _split() -> Column:
    return F.split("value", ",", -1).alias("f")


def _cell(k: int, width: int) -> Column:
    """A field; a CR at the end of the line is none of its last field."""
    field = F.col("f")[k]
    if k < width - 1:
        return field
    return F.when(field.endswith("\r"), F.substring(field, F.lit(1), F.length(field) - 1)).otherwise(field)


def _typed(value: Column, kind: ColType) -> Column:
    """The cell as its column's type, NULL if it is no such number.

    A cast alone also takes blanks around a number, a plus before an integer, and 1d or 0x1p3. What
    starts and ends like a plain number can be none of these; only the rest is matched in full.
    """
    if kind is ColType.STR:
        return value
    number = value.try_cast(kind.value)
    # texts compare by bytes; the last byte is had without counting characters
    digit_ends = F.substring(value.cast("binary"), -1, 1).between(F.lit(b"0"), F.lit(b"9"))
    if kind is ColType.INT:
        return F.when((value >= "-") & (value < ":") & digit_ends, number)
    plain = (value >= "+") & (value < ":") & digit_ends & ~value.contains("x") & ~value.contains("X")
    return F.when(plain, number).when(value.rlike(FLOAT), number)


def _names(header: str) -> list[str]:
    """Header fields; of equal names the later ones get their position."""
    names: list[str] = []
    for k, name in enumerate(header.split(",")):
        while name in names:
            name = f"{name}_{k}"
        names.append(name)
    return names


def _lines(text: DataFrame, header: str) -> DataFrame:
    """All lines, and which of them are the first ones of their files.

    A line's number in its task tells the first line of one file. In a folder, where a task reads parts of
    several files, a header is a line equal to it in the first part of a file; if a file has
    more of those, which one scan of the lines tells, it is the one with the least number.
    """
    if len(text.inputFiles()) == 1:
        return text.select("value", (F.monotonically_increasing_id() == 0).alias("is_header"))
    marked = text.select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.monotonically_increasing_id().alias("at"),
        (F.col("value").isin(header, header + "\r") & (F.col("_metadata.file_block_start") == 0)).alias("is_header"),
    )
    found = marked.filter("is_header").groupBy("file").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").persist()
    try:
        if found.isEmpty():
            return marked.select("value", "is_header")
        # a row for each such file; the driver lists them anyway
        firsts = text.sparkSession.createDataFrame(found.select("file", "first").collect(), "file string, first bigint")
    finally:
        found.unpersist()
    one = F.col("is_header") & (F.coalesce("first", "at") == F.col("at"))
    return marked.join(F.broadcast(firsts), "file", "left").select("value", one.alias("is_header"))


def read_csv(spark: SparkSession, path: str) -> tuple[Table, LoadReport]:
    """A table over one file, or over a folder of files that all start with the same header line.

    Blank lines are passed over, rows of another width are dropped, cells that are no number of their
    column's type are NULL. Row positions count the rows that are kept. In a folder the first line
    of a file is passed over if it equals the header; a later line that does is data, as in one file.
    """
    try:
        text = spark.read.text(path, lineSep="\n")
        top = [row["value"] for row in text.filter(F.col("_metadata.file_block_start") == 0).head(PEEK)]
    except AnalysisException as error:
        raise LoadError(str(error)) from error
    if not top:
        raise LoadError("Missing header line")
    header = top[0].removesuffix("\r")
    names = _names(header.removeprefix("\ufeff"))
    lines = _lines(text, header)
    body = lines.filter(_is_data())
    # most files have data right after the header, of which a folder's first file could have no more
    sample = next((line for line in top[1:] if line not in ("", "\r", header, header + "\r")), None)
    if sample is None:
        found = body.head(1)
        if not found:
            raise LoadError("No data rows")
        sample = found[0]["value"]
    fields = sample.removesuffix("\r").split(",")
    if len(fields) != len(names):
        raise LoadError(f"Header/data mismatch: {len(names)} vs {len(fields)}")
    types = [infer(value) for value in fields]

    # the number keeps the width's condition above the split, so that a line is split once
    split = body.select(_split(), F.monotonically_increasing_id().alias("at"))
    cells = split.filter((F.size("f") == len(names)) & (F.col("at") >= 0)).select("f")
    kept = cells.select(*(_typed(_cell(k, len(names)), kind).alias(name) for k, (name, kind) in enumerate(zip(names, types))))
    table = Table(kept, lambda: numbered(kept))
    return table, LoadReport(table, lines, names, types)
