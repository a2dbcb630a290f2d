"""A bounded cache of small results and of persisted filters."""

from __future__ import annotations

from collections import OrderedDict
from typing import TYPE_CHECKING

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame

if TYPE_CHECKING:
    from quern.operators.results import Result
    from quern.plans.query import Query


class ResultCache:
    """Least recently used results go first.

    Keys hold the table's version, so tables never share entries and a reloaded table starts anew.
    Results of more than max_rows rows are not kept. With persist_filters, the rows that a set of
    conditions selects are persisted (memory and disk) for the next query with the same conditions.
    """

    def __init__(self, capacity: int = 128, max_rows: int = 10_000, persist_filters: bool = False):
        if capacity < 1:
            raise ValueError("capacity must be positive")
        self.capacity, self.max_rows, self.persist_filters = capacity, max_rows, persist_filters
        self.hits = self.misses = 0
        self._results: OrderedDict[tuple, Result] = OrderedDict()
        self._filters: OrderedDict[tuple, DataFrame] = OrderedDict()

    def __len__(self) -> int:
        return len(self._results)

    def get(self, key: tuple) -> Result | None:
        found = self._results.get(key)
        if found is None:
            self.misses += 1
            return None
        self.hits += 1
        self._results.move_to_end(key)
        return found

    def put(self, key: tuple, result: Result) -> None:
        if len(result) > self.max_rows:
            return
        self._results[key] = result
        self._results.move_to_end(key)
        while len(self._results) > self.capacity:
            self._results.popitem(last=False)

    def filtered(self, query: Query, df: DataFrame, condition: Column) -> DataFrame:
        if not self.persist_filters:
            return df.filter(condition)
        key = (query.table.version, query.filters_, df is query.table.df)
        if key not in self._filters:
            self._filters[key] = df.filter(condition).persist(StorageLevel.MEMORY_AND_DISK)
        self._filters.move_to_end(key)
        while len(self._filters) > self.capacity:
            self._filters.popitem(last=False)[1].unpersist()
        return self._filters[key]

    def clear(self) -> None:
        self._results.clear()
        while self._filters:
            self._filters.popitem()[1].unpersist()
