"""Driver-side shapes of query results."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Row

from quern.model import ROW_INDEX


@dataclass(frozen=True)
class Result:
    """kind and value:

    aggregate: a number; multi_aggregate: name -> number; group_by: key -> number;
    group_by_multi: key -> name -> number; multi_dimensional: keys -> name -> number;
    select, rows: column -> values in row order.
    dimensions, measures and columns name what the value holds; rows are row positions.
    """

    kind: str
    value: Any
    dimensions: tuple[str, ...] = ()
    measures: tuple[str, ...] = ()
    columns: tuple[str, ...] = ()
    rows: tuple[int, ...] = ()

    @property
    def is_multi_dimensional(self) -> bool:
        return self.kind == "multi_dimensional"

    def __len__(self) -> int:
        return len(self.rows) if self.kind in ("select", "rows") else len(self.value) if isinstance(self.value, dict) else 1


def shaped(kind: str, groups: tuple[str, ...], names: tuple[str, ...], selection: tuple[str, ...], rows: list[Row]) -> Result:
    if kind in ("select", "rows"):
        ordered = sorted(rows, key=lambda r: r[ROW_INDEX])
        own = selection or (ROW_INDEX,)
        at = tuple(r[ROW_INDEX] for r in ordered)
        return Result(kind, {c: [r[c] for r in ordered] for c in own}, columns=own, rows=at)
    wide = len(names) > 1 or kind == "multi_dimensional"
    measured = [{n: r[n] for n in names} if wide else r[names[0]] for r in rows]
    if not groups:
        value: Any = measured[0] if measured else None
    elif len(groups) == 1:
        value = {r[groups[0]]: m for r, m in zip(rows, measured)}
    else:
        value = {tuple(r[g] for g in groups): m for r, m in zip(rows, measured)}
    return Result(kind, value, dimensions=groups, measures=names)
