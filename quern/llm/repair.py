"""Token ids in binary shards compressed by a Re-Pair grammar.

A block holds the ids of neighbouring documents. Its most frequent pairs of neighbouring symbols
become nonterminals, round by round, until no pair is frequent or the 16-bit symbols run out. Pairs
never reach across documents, so the block stores, beside rules and symbols, where each document's
symbols start and how many ids each rule expands to: one document, or a range of its ids, is decoded
without the rest. Blocks are rows of Parquet files, in ascending order of document id.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.bytebpe import VOCABULARY, encode
from quern.llm.common import few_rows_read_at_once, parts, ranges, ship, stored

MAGIC, TERMINALS, SYMBOLS = b"RPG1", 50257, 1 << 16
BLOCK, LEAST, END = 1 << 20, 32, 2
#: Slots (a power of two) of the table in which a round looks up its pairs; colliding pairs wait.
SLOT_BITS = 16
#: Bytes after which a row group of the block files ends. By Parquet's defaults sizes are looked at after 100 rows only:
#: up to 100 blocks of megabytes would make one page, which is held, compressed and read as a whole.
GROUP_BYTES = 4 << 20
PAGES = {
    "parquet.block.size": str(GROUP_BYTES),
    "parquet.page.size.row.check.min": "1",
    "parquet.page.size.row.check.max": "1",
    "parquet.page.size.check.estimate": "false",
    "parquet.enable.dictionary": "false",
}


def _slot(code: np.ndarray) -> np.ndarray:
    return ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - SLOT_BITS)).astype(np.intp)


def _frequent(code: np.ndarray, room: int) -> np.ndarray:
    """The pairs of a round, most frequent first, no two of them in one slot."""
    ordered = np.sort(code)
    starts = np.flatnonzero(ordered[1:] != ordered[:-1]) + 1
    starts = np.concatenate(([0], starts, [len(ordered)]))
    counts = np.diff(starts)
    often = np.flatnonzero(counts >= LEAST)
    often = often[np.argsort(-counts[often], kind="stable")]
    pairs = ordered[starts[often]]
    _, first = np.unique(_slot(pairs), return_index=True)
    return pairs[np.sort(first)][:room]


def compress(ids: np.ndarray, sizes: np.ndarray) -> bytes:
    """A block of the uint16 ids of documents that have `sizes` ids each."""
    symbols = ids.astype(np.uint32)
    last = np.zeros(len(symbols), bool)
    last[np.cumsum(sizes)[sizes > 0] - 1] = True
    width = np.ones(SYMBOLS, np.int64)
    rules, rounds, top = [], [], TERMINALS
    while len(symbols) > 1 and top < SYMBOLS:
        code = symbols[:-1] << np.uint32(16)
        code |= symbols[1:]
        inner = code[~last[:-1]]
        pairs = _frequent(inner, SYMBOLS - top) if len(inner) else inner
        if not len(pairs):
            break
        # a slot without a pair holds the last pair of symbols, which only the last rule could use
        keys = np.full(1 << SLOT_BITS, 0xFFFFFFFF, np.uint32)
        held = np.zeros(1 << SLOT_BITS, np.uint32)
        keys[_slot(pairs)] = pairs
        held[_slot(pairs)] = np.arange(top, top + len(pairs))
        found = keys[_slot(code)] == code
        found[last[:-1]] = False
        place = np.flatnonzero(found)
        # of overlapping pairs every second one is replaced
        order = np.arange(len(place))
        fresh = np.concatenate(([True], place[1:] != place[:-1] + 1))
        place = place[((order - np.maximum.accumulate(np.where(fresh, order, 0))) & 1) == 0]
        symbols[place] = held[_slot(code[place])]
        last[place] = last[place + 1]
        keep = np.ones(len(symbols), bool)
        keep[place + 1] = False
        symbols, last = symbols[keep], last[keep]
        pair = np.stack([pairs >> 16, pairs & 0xFFFF], 1).astype("<u2")
        width[top : top + len(pairs)] = width[pair].sum(1)
        rules.append(pair)
        rounds.append(len(pairs))
        top += len(pairs)
    table = np.concatenate(rules) if rules else np.empty((0, 2), "<u2")
    taken = np.zeros(len(sizes), np.int64)
    taken[sizes > 0] = np.diff(np.flatnonzero(last), prepend=-1)
    head = struct.pack("<4sIIII", MAGIC, len(sizes), len(table), len(rounds), len(symbols))
    parts = (sizes, taken, rounds, width[TERMINALS:top])
    return b"".join((head, *(np.asarray(x).astype("<u4").tobytes() for x in parts), table.tobytes(), symbols.astype("<u2").tobytes()))


def expansions(table: np.ndarray, rounds) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expanded ids of all symbols in one array, and each symbol's start and length there."""
    flat = [np.arange(TERMINALS, dtype=np.uint16)]
    start, width = np.arange(TERMINALS, dtype=np.int64), np.ones(TERMINALS, np.int64)
    done = 0
    for n in rounds:
        pair = table[done : done + n].astype(np.int64).ravel()
        so_far = np.concatenate(flat) if len(flat) > 1 else flat[0]
        flat = [so_far, so_far[ranges(start[pair], width[pair])]]
        size = width[pair].reshape(-1, 2).sum(1)
        start = np.concatenate([start, len(so_far) + np.cumsum(size) - size])
        width = np.concatenate([width, size])
        done += n
    return np.concatenate(flat), start, width


class Block:
    """Reads a block: all of it, one document, or a range of a document's ids."""

    def __init__(self, data: bytes):
        magic, docs, rules, rounds, n = struct.unpack_from("<4sIIII", data)
        if magic != MAGIC:
            raise ValueError("not a block of token ids")
        at = 20

        def take(count: int, kind: str) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(data, kind, count, at)
            at += got.nbytes
            return got

        self.sizes, taken = take(docs, "<u4").astype(np.int64), take(docs, "<u4").astype(np.int64)
        self.rounds, self.widths = take(rounds, "<u4"), take(rules, "<u4").astype(np.int64)
        self.table, self.symbols = take(2 * rules, "<u2").reshape(-1, 2), take(n, "<u2")
        self.bounds = np.concatenate(([0], np.cumsum(taken)))

    def all_ids(self) -> np.ndarray:
        flat, start, width = expansions(self.table, self.rounds)
        return flat[ranges(start[self.symbols], width[self.symbols])]

    def document(self, k: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids start to stop of document k; symbols outside of the range are skipped by length."""
        own = self.symbols[self.bounds[k] : self.bounds[k + 1]].astype(np.int64)
        width = np.where(own < TERMINALS, 1, self.widths[np.maximum(own - TERMINALS, 0)] if len(self.widths) else 1)
        ends = np.cumsum(width)
        stop = int(self.sizes[k]) if stop is None else min(stop, int(self.sizes[k]))
        if start >= stop:
            return np.empty(0, np.uint16)
        a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left")
        out: list[int] = []
        stack = own[a : b + 1][::-1].tolist()
        while stack:
            symbol = stack.pop()
            if symbol < TERMINALS:
                out.append(symbol)
            else:
                left, right = self.table[symbol - TERMINALS]
                stack += (int(right), int(left))
        skipped = start - int(ends[a] - width[a])
        return np.array(out[skipped : skipped + stop - start], np.uint16)


def _write(path: str, end: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, before = TaskContext.get().partitionId(), 0
        keys, held, size, kind = [], [], 0, None

        def flush() -> pa.RecordBatch:
            sizes = np.array([len(x) for x in held], np.int64)
            data = compress(np.concatenate(held), sizes)
            row = [pa.array([task], pa.int64()), pa.array([before], pa.int64()), pa.array([size], pa.int64())]
            return pa.RecordBatch.from_arrays([*row, pa.array([keys], pa.list_(kind)), pa.array([data], pa.binary())], ["part", "start", "n_ids", "doc_ids", "block"])

        for batch in batches:
            kind = batch.column(0).type
            for key, value in zip(batch.column(0), batch.column(1)):
                ids = encode(value.as_py(), path, end)
                if held and size + len(ids) > block:
                    yield flush()
                    before += size
                    keys, held, size = [], [], 0
                keys.append(key.as_py())
                held.append(ids)
                size += len(ids)
        if held:
            yield flush()

    return run


def write_ids(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    end: int = END,
    block: int = BLOCK,
    path: str = public_tokenizers.path(VOCABULARY),
) -> DataFrame:
    """Encode all documents in ascending id order into block files; returns the table of the files:
    part, start (ids before the block in its part), n_ids, doc_ids, block.

    A null or empty text is the end id alone. Null ids come first; rows with equal ids are ordered
    by text. A document longer than `block` ids is a block of its own. An empty table gives none.
    """
    ship(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    narrow = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    # the range keys that Spark samples for the driver are ids alone; equal ids share a partition
    ordered = narrow.repartitionByRange(*parts(narrow), "id").sortWithinPartitions("id", "text")
    schema = f"part long, start long, n_ids long, doc_ids array<{kind}>, block binary"
    with few_rows_read_at_once(df.sparkSession):
        return stored(ordered.mapInArrow(_write(path, end, block), schema), "blocks", **PAGES)


def _read(base: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                block = Block(batch.column("block")[k].as_py())
                ids = block.all_ids().astype("<u4")
                ends = np.cumsum(block.sizes)
                starts = ends - block.sizes
                first = base[batch.column("part")[k].as_py()] + batch.column("start")[k].as_py()
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts, ends)]
                values = [batch.column("doc_ids")[k].values, *(pa.array(x, pa.int64()) for x in (starts + first, block.sizes, crc))]
                yield pa.RecordBatch.from_arrays(values, ["id", "start", "n_tokens", "ids_crc32"])

    return run


def read_ids(files: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document of block files: the id column, start, n_tokens, ids_crc32 of its decoded ids.

    Only one number for each part (a task that wrote) reaches the driver.
    """
    kind = files.schema["doc_ids"].dataType.elementType.simpleString()
    base, at = {}, 0
    for row in sorted(files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()):
        base[row["part"]] = at
        at += row["n"]
    out = files.select("part", "start", "doc_ids", "block").mapInArrow(_read(base), f"id {kind}, start long, n_tokens long, ids_crc32 long")
    return out.withColumnRenamed("id", id_col)
