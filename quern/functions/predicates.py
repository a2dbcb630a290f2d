"""Typed predicates, compiled to column expressions that Spark can push to a scan.

A literal's type must be the column's. A typed literal of another type never matches a number and
is an error for text; nothing is ever cast. A bare Python value takes the column's type where it
can: a whole number becomes a float for a float column. No comparison matches NaN or NULL.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.errors import QueryError
from quern.model import ColType, quoted

#: What a bigint holds.
LEAST, MOST = -(1 << 63), (1 << 63) - 1


@dataclass(frozen=True)
class Literal:
    kind: ColType
    value: int | float | str

    def __post_init__(self):
        if self.kind is ColType.INT and not LEAST <= self.value <= MOST:
            raise QueryError(f"{self.value} is no 64-bit integer")


def int_value(value: int) -> Literal:
    return Literal(ColType.INT, int(value))


def float_value(value: float) -> Literal:
    return Literal(ColType.FLOAT, float(value))


def str_value(value: str) -> Literal:
    return Literal(ColType.STR, str(value))


@dataclass(frozen=True)
class Predicate:
    """op is one of =, >, <, between; values are one or two literals or bare values."""

    op: str
    values: tuple

    def __post_init__(self):
        wanted = {"=": 1, ">": 1, "<": 1, "between": 2}.get(self.op)
        if wanted is None:
            raise QueryError(f"Unknown predicate {self.op}")
        if len(self.values) != wanted:
            raise QueryError(f"{self.op} takes {wanted} value{'s' * (wanted > 1)}, got {len(self.values)}")


def equals(value) -> Predicate:
    return Predicate("=", (value,))


def greater_than(value) -> Predicate:
    return Predicate(">", (value,))


def less_than(value) -> Predicate:
    return Predicate("<", (value,))


def between(low, high) -> Predicate:
    """Both ends included."""
    return Predicate("between", (low, high))


def typed(value, kind: ColType) -> Literal:
    """A literal for a bare Python value that is compared with a column of this type."""
    if isinstance(value, Literal):
        return value
    if isinstance(value, bool) or not isinstance(value, (int, float, str)):
        raise QueryError(f"No literal type for {value!r}")
    if isinstance(value, str):
        return str_value(value)
    if isinstance(value, int) and kind is not ColType.FLOAT:
        return int_value(value)
    return float_value(value)


def compile_predicate(column: str, kind: ColType, predicate: Predicate) -> Column:
    literals = [typed(v, kind) for v in predicate.values]
    if any(x.kind is not kind for x in literals):
        if kind is ColType.STR:
            raise QueryError("Predicate & column-type combination not supported")
        return F.lit(False)
    if kind is ColType.FLOAT and any(math.isnan(x.value) for x in literals):
        return F.lit(False)
    own, values = quoted(column), [F.lit(x.value).cast(kind.value) for x in literals]
    if predicate.op == "=":
        return own == values[0]
    if predicate.op == "<":  # NaN is above all numbers in Spark, so it can't match here or below
        return own < values[0]
    if predicate.op == "between":
        return own.between(*values)
    above = own > values[0]
    return above & ~F.isnan(own) if kind is ColType.FLOAT else above
