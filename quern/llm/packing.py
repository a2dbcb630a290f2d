"""Packing by shortest-pack-first over the histogram of lengths.

Documents become pieces of at most `size` ids. Only the histogram of piece lengths (at most `size`
numbers) reaches the driver, where lengths are placed longest first, each into the packs that hold
least so far; what is updated are counts of packing patterns, never single packs. The patterns are
then joined back by rank: the k-th piece of a length takes the k-th slot for that length. Ranks come
from a counter kept while pieces are made and from sums of the counts of earlier tasks, one array for
each task, so no sort and no window runs over the pieces.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.bytebpe import VOCABULARY, encode
from quern.llm.common import ship, spread, stored

SIZE, END = 1024, 0


def place_lengths(histogram: dict[int, int], size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """Packing patterns (lengths in a pack, longest first) and how many packs follow each."""
    open_packs: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)  # by free space
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        # the emptiest packs come first; what one piece makes of them is met again further down
        for free in range(size, length - 1, -1):
            if not open_packs.get(free):
                continue
            packs, changed = open_packs[free], []
            while packs and left:
                pattern, n = packs.pop()
                if n > left:
                    packs.append((pattern, n - left))
                    n = left
                changed.append(((*pattern, length), n))
                left -= n
            open_packs[free - length] += changed
            if not left:
                break
        if left:  # new packs take as many of this length as fit
            fits = size // length
            for n, each in ((left // fits, fits), (1, left % fits)):
                if n and each:
                    open_packs[size - each * length].append(((length,) * each, n))
    return [pack for free in sorted(open_packs) for pack in open_packs[free]]


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """For each length the slots in rank order: rows of first rank, first sequence id, offset."""
    out: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    used: dict[int, int] = defaultdict(int)
    sequence = 0
    for pattern, n in patterns:
        offset = 0
        for length in pattern:
            out[length].append((used[length], sequence, offset))
            used[length] += n
            offset += length
        sequence += n
    return {length: np.array(rows, np.int64) for length, rows in out.items()}


def _pieces(path: str, size: int, end: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                rows, start, length, crc, total, rank, kept = [], [], [], [], [], [], []
                for row, value in enumerate(part.column(1)):
                    ids = encode(value.as_py(), path, end).astype("<u4")
                    for at in range(0, len(ids), size):
                        piece = ids[at : at + size]
                        n = len(piece)
                        rows.append(row)
                        start.append(at)
                        length.append(n)
                        crc.append(zlib.crc32(piece))
                        total.append(len(ids))
                        rank.append(seen[n])
                        seen[n] += 1
                        if with_ids:
                            kept.append(piece.tobytes())
                values = [part.column(0).take(pa.array(rows, pa.int64()))]
                values += [pa.array(x, pa.int64()) for x in (start, length, crc, total, [task] * len(rows), rank)]
                names = ["id", "start", "length", "ids_crc32", "doc_tokens", "task", "local"]
                if with_ids:
                    values, names = [*values, pa.array(kept, pa.binary())], [*names, "ids"]
                values.append(pa.nulls(len(rows), pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(values, [*names, "seen"])
        if seen.any():  # the last row of a task holds how many pieces of each length it made
            kinds = [batch.schema.field(0).type] + [pa.int64()] * 6 + [pa.binary()] * with_ids
            values = [pa.nulls(1, kind) for kind in kinds]
            values[names.index("task")] = pa.array([task], pa.int64())
            yield pa.RecordBatch.from_arrays([*values, pa.array([seen.tolist()], pa.list_(pa.int64()))], [*names, "seen"])

    return run


def _assign(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for n in np.unique(length):
                of = np.flatnonzero(length == n)
                rows = table[int(n)]
                at = rows[np.searchsorted(rows[:, 0], rank[of], "right") - 1]
                sequence[of] = at[:, 1] + rank[of] - at[:, 0]
                offset[of] = at[:, 2]
            kept = [c for c in batch.schema.names if c != "rank"]
            values = [*(batch.column(c) for c in kept), pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(values, [*kept, "sequence_id", "offset"])

    return run


def pack_documents(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = SIZE,
    end: int = END,
    with_ids: bool = False,
    path: str = public_tokenizers.path(VOCABULARY),
) -> DataFrame:
    """Pieces of all documents and their places: the id column, start, length, ids_crc32,
    doc_tokens, sequence_id, offset; with `with_ids` also ids (little-endian 32-bit).

    A null or empty text is the end id alone. A document is cut every `size` ids, so only its last
    piece is shorter. Repeated rows and ids are packed as often as they occur; an empty table
    gives no rows; other columns are not read. A sequence holds whole pieces without gaps.
    """
    spark = df.sparkSession
    ship(spark)
    kind = df.schema[id_col].dataType.simpleString()
    narrow = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, task long, local long"
    schema += ", ids binary" * with_ids + ", seen array<long>"
    made = stored(spread(narrow).mapInArrow(_pieces(path, size, end, with_ids), schema), "pieces")

    counts = stored(made.filter("seen is not null").select("task", F.posexplode("seen").alias("length", "n")), "lengths")
    found = counts.groupBy("length").agg(F.sum("n").alias("n")).filter("n > 0").collect()  # `size` rows at most
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    sums = counts.select("task", F.struct("length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n")).alias("base"))
    # `size` + 1 numbers for each task: broadcast while Spark finds that small, else pieces, without ids, go to their task's row
    base = sums.groupBy("task").agg(F.sort_array(F.collect_list("base"))["n"].alias("base"))

    shared = spark.sparkContext.broadcast(slots(place_lengths({r["length"]: r["n"] for r in found}, size)))
    pieces = made.filter("seen is null").drop("seen")
    ranked = pieces.join(base, "task").withColumn("rank", F.get("base", F.col("length").cast("int")) + F.col("local"))
    fields = ["id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
    schema = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    out = ranked.select(*fields, "rank").mapInArrow(_assign(shared), schema + ", sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)
