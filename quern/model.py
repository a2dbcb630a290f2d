"""Tables of three column types over DataFrames."""

from __future__ import annotations

import enum
import itertools
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.errors import MissingColumnError, QueryError

if TYPE_CHECKING:
    from quern.operators.cache import ResultCache
    from quern.plans.query import Query

ROW_INDEX = "row_index"
_versions = itertools.count(1)


class ColType(enum.Enum):
    INT = "bigint"
    FLOAT = "double"
    STR = "string"


_TYPES: dict[type[T.DataType], ColType] = {
    T.ByteType: ColType.INT, T.ShortType: ColType.INT, T.IntegerType: ColType.INT, T.LongType: ColType.INT,
    T.FloatType: ColType.FLOAT, T.DoubleType: ColType.FLOAT, T.StringType: ColType.STR,
}


def quoted(name: str) -> Column:
    """The column of exactly this name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def normalised(df: DataFrame) -> DataFrame:
    """df with whole numbers as bigint and floats as double; other types stay as they are."""
    wide = {
        f.name: quoted(f.name).cast(_TYPES[type(f.dataType)].value)
        for f in df.schema.fields
        if type(f.dataType) in _TYPES and f.dataType.simpleString() != _TYPES[type(f.dataType)].value
    }
    return df.select(*(wide.get(c, quoted(c)).alias(c) for c in df.columns)) if wide else df


@dataclass(frozen=True, eq=False)
class Table:
    """A lazy table. index gives its DataFrame with the 0-based position of each row as row_index.

    Columns of other types than the three can be selected, but neither compared nor aggregated.
    """

    df: DataFrame
    index: Callable[[], DataFrame]
    version: int = field(default_factory=lambda: next(_versions))
    _memo: dict = field(default_factory=dict, repr=False)

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    def col_type(self, name: str) -> ColType:
        if name not in self.df.columns:
            raise MissingColumnError(name)
        kind = _TYPES.get(type(self.df.schema[name].dataType))
        if kind is None:
            raise QueryError(f"Column {name} has type {self.df.schema[name].dataType.simpleString()}, which is only for selecting")
        return kind

    def column(self, position: int) -> Column:
        return quoted(self.df.columns[position])

    def get_column(self, name: str) -> Column:
        if name not in self.df.columns:
            raise MissingColumnError(name)
        return quoted(name)

    def row_count(self) -> int:
        if "rows" not in self._memo:
            self._memo["rows"] = self.df.count()
        return self._memo["rows"]

    def indexed(self) -> DataFrame:
        if "indexed" not in self._memo:
            self._memo["indexed"] = self.index()
        return self._memo["indexed"]

    def to_arrow(self):
        """The whole table on the driver, as a pyarrow.Table."""
        return self.df.toArrow()

    def query(self, cache: ResultCache | None = None) -> Query:
        from quern.plans.query import Query

        return Query(self, cache=cache)

    # Direct operators: the same plans without a builder.

    def filter(self, column: str, predicate) -> DataFrame:
        """Positions of the rows that match."""
        return self.query().where(column, predicate).to_df()

    def aggregate(self, column: str, op) -> int | float | None:
        return self.query().aggregate(column, op).execute().value

    def group_by(self, key: str, column: str, op) -> DataFrame:
        return self.query().group_by(key).aggregate(column, op).to_df()
