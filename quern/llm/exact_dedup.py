"""Exact duplicates with a heavy-hitter split.

Every text is reduced to the SHA-256 of its characters other than ASCII white space. Each task
summarises its digests with a Misra-Gries counter set; the merged summaries name at most
`counters` candidates. Candidates are counted exactly, and the winners of those that really are
frequent are broadcast: their rows are decided where they lie. All other digests, whose groups are
small by then, take an ordinary shuffle of (digest, id, length) rows. Texts are never shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import byte_rows, forget, row_numbers, ship, spread, stored

SPACE = b" \t\n\x0b\x0c\r"
#: Counters of each summary. A digest is frequent from 2n / COUNTERS rows, and from LEAST rows.
COUNTERS, LEAST = 16384, 64


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = 0
    for batch in batches:
        text = batch.column(1)
        sha = [hashlib.sha256(raw.translate(None, SPACE)).digest() for raw in byte_rows(text)]
        key = np.frombuffer(b"".join(s[:8] for s in sha), "<i8")
        size = pc.fill_null(pc.utf8_length(text), 0).cast(pa.int64())
        rest, names = batch.columns[2:], batch.schema.names[2:]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sha, pa.binary()), pa.array(key), size, row_numbers(rows, batch.num_rows), *rest],
            ["id", "sha", "h", "size", "row", *names],
        )
        rows += batch.num_rows


def misra_gries(keys: np.ndarray, counts: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Reduce weighted keys to `limit` counters; also returns what was taken off each counter."""
    keys, place = np.unique(keys, return_inverse=True)
    counts = np.bincount(place, counts, len(keys)).astype(np.int64)
    if len(keys) <= limit:
        return keys, counts, 0
    cut = int(np.partition(counts, len(counts) - limit - 1)[len(counts) - limit - 1])
    left = counts > cut
    return keys[left], counts[left] - cut, cut


def _summaries(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, off, rows = np.empty(0, np.int64), np.empty(0, np.int64), 0, 0
        for batch in batches:
            new = batch.column(0).to_numpy()
            rows += len(new)
            keys, counts, cut = misra_gries(
                np.concatenate([keys, new]), np.concatenate([counts, np.ones(len(new), np.int64)]), limit
            )
            off += cut
        if rows:
            # the first row of a task also carries its number of rows and its error
            first = np.arange(len(keys) + 1) == 0
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([[0], keys]).astype(np.int64)),
                    pa.array(np.concatenate([[0], counts]).astype(np.int64)),
                    pa.array(np.where(first, rows, 0)),
                    pa.array(np.where(first, off, 0)),
                ],
                ["h", "n", "rows", "off"],
            )

    return run


def _best() -> Column:
    """Orders rows of a group: longest, then smallest id (a null id is last), then any one."""
    return F.struct((-F.col("size")).alias("a"), F.col("id").isNull().alias("b"), F.col("id").alias("c"), F.col("row").alias("d"))


def exact_dedup(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    counters: int = COUNTERS,
    least: int = LEAST,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per input row: the id column, keep_id, group_size, kept, text_sha256, then the columns in `keep`.

    A null text counts as empty; all texts without characters are one group. Ties in length go to
    the smallest id, null ids last; of rows that are equal in these too, one is kept, so each group has
    one kept row. An empty table gives no rows. Other columns of df are not read.
    """
    ship(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    own = [f"k{i}" for i in range(len(keep))]
    narrow = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *(F.col(c).alias(k) for c, k in zip(keep, own)))
    more = "".join(f", {k} {df.schema[c].dataType.simpleString()}" for c, k in zip(keep, own))
    rows = stored(spread(narrow).mapInArrow(_digests, f"id {kind}, sha binary, h long, size long, row long{more}"), "digests")

    summary = stored(rows.select("h").mapInArrow(_summaries(counters), "h long, n long, rows long, off long"), "counters")
    total, error = summary.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.coalesce(F.sum("off"), F.lit(0))).first()
    frequent = max(2 * total / counters, least)
    # A digest with `frequent` rows keeps a sum of frequent - error at least; as error <= n / counters
    # and the sums add up to n at most, no more than `counters` keys pass.
    candidates = summary.groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= max(1, frequent - error)).select("h")
    heavy = stored(
        rows.join(F.broadcast(candidates), "h")
        .groupBy("sha")
        .agg(F.min(_best()).alias("best"), F.count(F.lit(1)).alias("group_size"))
        .filter(F.col("group_size") >= frequent)
        .select("sha", F.col("best.c").alias("keep_id"), F.col("best.d").alias("keep_row"), "group_size"),
        "frequent",
    )
    forget(summary)
    all_of = Window.partitionBy("sha")
    here = rows.join(F.broadcast(heavy), "sha").select("id", "sha", "keep_id", (F.col("row") == F.col("keep_row")).alias("kept"), "group_size", *own)
    moved = (
        rows.select("id", "sha", "size", "row", *own)
        .join(F.broadcast(heavy.select("sha")), "sha", "left_anti")
        .select("*", F.min(_best()).over(all_of).alias("best"), F.count(F.lit(1)).over(all_of).alias("group_size"))
        .select("id", "sha", F.col("best.c").alias("keep_id"), (F.col("row") == F.col("best.d")).alias("kept"), "group_size", *own)
    )
    return here.unionByName(moved).select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        "kept",
        F.lower(F.hex("sha")).alias("text_sha256"),
        *(F.col(k).alias(c) for c, k in zip(keep, own)),
    )
