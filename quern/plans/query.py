"""The fluent query builder: an immutable plan that compiles to one DataFrame."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.errors import EmptyInputError, QueryError
from quern.functions.aggregates import Aggregate, AggOp
from quern.functions.predicates import Predicate, compile_predicate
from quern.model import ROW_INDEX, ColType, Table, quoted
from quern.operators.results import Result, shaped

if TYPE_CHECKING:
    from quern.operators.cache import ResultCache

#: Counts the rows that ungrouped aggregates saw, to tell no rows from NULLs only.
_SEEN = "__rows_seen"


@dataclass(frozen=True, eq=False)
class Query:
    table: Table
    filters_: tuple[tuple[str, Predicate], ...] = ()
    groups: tuple[str, ...] = ()
    aggregates_: tuple[Aggregate, ...] = ()
    selection: tuple[str, ...] = ()
    limit_: int | None = None
    cache: ResultCache | None = None
    allow_any_key: bool = False

    def where(self, column: str, predicate: Predicate | str, *values) -> Query:
        """Add a condition: `where("v", greater_than(3))` or `where("v", ">", 3)`. Conditions are joined by AND."""
        made = predicate if isinstance(predicate, Predicate) else Predicate(str(predicate).lower(), values)
        return replace(self, filters_=(*self.filters_, (column, made)))

    def filters(self, conditions: Iterable[tuple[str, Predicate]]) -> Query:
        return replace(self, filters_=(*self.filters_, *conditions))

    def group_by(self, *columns: str, allow_any_key: bool | None = None) -> Query:
        """Add keys. Keys are text columns unless allow_any_key is set."""
        any_key = self.allow_any_key if allow_any_key is None else allow_any_key
        return replace(self, groups=(*self.groups, *columns), allow_any_key=any_key)

    def aggregate(self, column: str, op: AggOp | str, alias: str | None = None) -> Query:
        return replace(self, aggregates_=(*self.aggregates_, Aggregate(column, AggOp.of(op), alias)))

    def aggregates(self, measures: Iterable[tuple]) -> Query:
        """Add several (column, op) or (column, op, alias)."""
        made = tuple(Aggregate(m[0], AggOp.of(m[1]), *m[2:]) for m in measures)
        return replace(self, aggregates_=(*self.aggregates_, *made))

    def select(self, *columns: str) -> Query:
        """Set the columns; an earlier selection is replaced."""
        return replace(self, selection=tuple(columns))

    def limit(self, n: int) -> Query:
        """The first n rows in row order, or the first n groups in key order."""
        if n < 0:
            raise QueryError("limit must not be negative")
        return replace(self, limit_=n)

    def no_cache(self) -> Query:
        return replace(self, cache=None)

    @property
    def key(self) -> tuple:
        """Equal for queries that have equal results or equal faults; the table's version is part of it."""
        return (self.table.version, self.filters_, self.groups, self.aggregates_, self.selection, self.limit_, self.allow_any_key)

    def _condition(self) -> Column | None:
        made = None
        for column, predicate in self.filters_:
            one = compile_predicate(column, self.table.col_type(column), predicate)
            made = one if made is None else made & one
        return made

    def _measures(self) -> list[Column]:
        names = [*self.groups, *(a.name for a in self.aggregates_)]
        twice = {n for n in names if names.count(n) > 1}
        if twice:
            raise QueryError(f"Several output columns are called {', '.join(sorted(twice))}")
        return [a.compile(self.table.col_type(a.column)) for a in self.aggregates_]

    def _kind(self) -> str:
        shape = (min(len(self.groups), 2), min(len(self.aggregates_), 2), bool(self.selection))
        kinds = {
            (0, 1, False): "aggregate", (0, 2, False): "multi_aggregate", (1, 1, False): "group_by",
            (1, 2, False): "group_by_multi", (2, 1, False): "multi_dimensional", (2, 2, False): "multi_dimensional",
            (0, 0, True): "select", (0, 0, False): "rows",
        }
        if shape not in kinds:
            raise QueryError("Invalid query combination")
        return kinds[shape]

    def _plan(self, seen: bool = False, ordinals: bool = False) -> DataFrame:
        condition, kind = self._condition(), self._kind()
        in_rows = kind in ("select", "rows")
        numbered = in_rows and (kind == "rows" or ordinals or self.limit_ is not None)
        df = self.table.indexed() if numbered else self.table.df
        if condition is not None:
            df = self.cache.filtered(self, df, condition) if self.cache is not None else df.filter(condition)
        if in_rows:
            for column in self.selection:
                self.table.get_column(column)
            if self.limit_ is not None:
                df = df.orderBy(ROW_INDEX).limit(self.limit_)
            columns = list(dict.fromkeys(self.selection))
            return df.select(*([ROW_INDEX] if kind == "rows" or ordinals else []), *map(quoted, columns))
        measures = self._measures()
        if not self.groups:
            df = df.agg(*measures, *([F.count(F.lit(1)).alias(_SEEN)] if seen else []))
            return df if self.limit_ is None else df.limit(self.limit_)
        for group in self.groups:
            if not self.allow_any_key and self.table.col_type(group) is not ColType.STR:
                raise QueryError(f"Group key {group} must be a text column")
            self.table.get_column(group)
        df = df.groupBy(*map(quoted, self.groups)).agg(*measures)
        return df if self.limit_ is None else df.orderBy(*map(quoted, self.groups)).limit(self.limit_)

    def to_df(self) -> DataFrame:
        """The lazy result. No rows under an ungrouped aggregate give NULL (COUNT: 0), as in SQL."""
        return self._plan()

    def execute(self, max_rows: int = 1_000_000) -> Result:
        """The result on the driver, in the shape of its kind; from the cache if it is there.

        Raises EmptyInputError for an ungrouped aggregate of no rows, and QueryError for more than
        max_rows rows (use to_df for those).
        """
        if self.cache is not None and (found := self.cache.get(self.key)) is not None:
            return found
        kind = self._kind() if not self.filters_ else (self._condition(), self._kind())[1]
        rows = self._plan(seen=True, ordinals=True).limit(max_rows + 1).collect()
        if len(rows) > max_rows:
            raise QueryError(f"More than {max_rows} rows; use to_df()")
        if not self.groups and self.aggregates_:
            if rows and not rows[0][_SEEN]:
                raise EmptyInputError
        result = shaped(kind, self.groups, tuple(a.name for a in self.aggregates_), self.selection, rows)
        if self.cache is not None:
            self.cache.put(self.key, result)
        return result
