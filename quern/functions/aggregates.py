"""Aggregates over numeric columns, all computed in one pass."""

from __future__ import annotations

import enum
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.errors import QueryError
from quern.model import ColType, quoted


class AggOp(enum.Enum):
    SUM = "sum"
    COUNT = "count"
    AVG = "avg"
    MIN = "min"
    MAX = "max"

    @classmethod
    def of(cls, op: AggOp | str) -> AggOp:
        """An operator itself, or by its name in any case."""
        if isinstance(op, cls):
            return op
        try:
            return cls(str(op).lower())
        except ValueError:
            raise QueryError(f"Unknown op {op}") from None


@dataclass(frozen=True)
class Aggregate:
    column: str
    op: AggOp
    alias: str | None = None

    @property
    def name(self) -> str:
        return self.alias if self.alias is not None else f"{self.column}_{self.op.value}".lower()

    def compile(self, kind: ColType) -> Column:
        """Sum and average carry NaN on, minimum and maximum pass over it; all pass over NULL.

        A sum of integers beyond 64 bits is an error, never a wrapped number.
        """
        if kind is ColType.STR:
            raise QueryError(f"Cannot aggregate text column {self.column}")
        own = quoted(self.column)
        if kind is ColType.FLOAT and self.op in (AggOp.MIN, AggOp.MAX):
            own = F.when(~F.isnan(own), own)
        made = {AggOp.SUM: F.sum, AggOp.COUNT: F.count, AggOp.AVG: F.avg, AggOp.MIN: F.min, AggOp.MAX: F.max}[self.op](own)
        return made.alias(self.name)
