"""SimHash near-duplicates over a hierarchical index in Gray order.

Equal fingerprints are one class. Fingerprints that differ in at most `distance` bits agree on one of
distance + 1 blocks of bits, so each distinct fingerprint goes to one bucket for each block. A
bucket is indexed where it lies: its fingerprints are sorted by Gray rank, neighbours form groups,
and a group's node holds the bits that all of its members share and that no node above holds
already. A search goes down from the roots, adds up differing bits and drops a whole group as soon as
the sum exceeds the distance, or when all of the group is linked to the searching fingerprint already.
A bucket yields at most one link for each of its fingerprints (a forest, never all pairs). Buckets
above `bucket_rows` are dealt as pairs of parts. Components are joined up over all buckets by
passing on the smallest label, with tables in the shared folder between rounds.

A given similarity of shingle sets lets fingerprints differ in so many bits that blocks of bits would tell
little. Texts then share a bucket if they agree on the least hashes of a band, the index drops what
differs in more bits than similar sets do but for rare cases, and a sketch of least hashes, which goes
along, decides on each pair that is left.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import byte_rows, forget, hot_join, hot_keys, parts, ranges, row_numbers, ship, spread, stored

SHINGLE, SEED, DISTANCE = 4, 42, 4
#: Rows of a bucket that one task indexes, members of a node, searches at once, pairs at once.
BUCKET_ROWS, FANOUT, SEARCHES, FRONTIER = 1 << 20, 8, 2048, 1 << 20


#: Bits that texts of a given similarity differ in at most (similarity 0.8: 9 on average, 3 standard deviation).
FAR = 16
#: Least hashes of a sketch, of which BANDS times BAND make the bands, and rows of a bucket for one task.
HASHES, BANDS, BAND, SKETCH_ROWS = 128, 8, 4, 1 << 17
#: A sketch holds four bits of each least hash, so its similarity has a standard error of 0.04 at 0.8; this
#: much less is taken for enough.
SLACK = 0.02


def shingle_hashes(raw: bytes, words: int = SHINGLE, seed: int = SEED) -> Iterator[np.ndarray]:
    """XXH64 of the shingles of UTF-8 text, in parts."""
    import xxhash

    parts = raw.lower().split()  # bytes: only A-Z and ASCII white space
    if not parts:
        return
    text, digest = b" ".join(parts), xxhash.xxh64_intdigest
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    count = max(1, len(parts) - words + 1)
    starts = np.concatenate(([0], ends[: count - 1] + 1))
    ends = ends[min(words, len(parts)) - 1 :]
    for lo in range(0, count, 100_000):
        cut = slice(lo, lo + 100_000)
        yield np.array([digest(text[a:b], seed) for a, b in zip(starts[cut].tolist(), ends[cut].tolist())], ">u8")


def _majority(hashes: Iterator[np.ndarray]) -> int:
    ones, count = np.zeros(64, np.int64), 0
    for part in hashes:
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        count += len(part)
    return int(np.packbits(ones * 2 > count).view(">u8")[0])


def fingerprint(raw: bytes, words: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash of UTF-8 text: the majority of the bits of its shingles' XXH64."""
    return _majority(shingle_hashes(raw, words, seed))


@lru_cache(1)
def _functions() -> tuple[np.ndarray, np.ndarray]:
    """A mask and an odd factor for each hash function."""
    import xxhash

    return tuple(np.array([xxhash.xxh64_intdigest(bytes([k, n])) | n for k in range(HASHES)], np.uint64) for n in (0, 1))


def sketch(raw: bytes, words: int, seed: int = SEED) -> tuple[int, bytes, list[int]]:
    """SimHash of the set of shingles, four bits of each least hash, and a key for each band of them."""
    import xxhash

    hashes = np.unique(np.concatenate([np.empty(0, ">u8"), *shingle_hashes(raw, words, seed)]))
    mask, factor = _functions()
    least = np.full(HASHES, 0xFFFFFFFFFFFFFFFF, np.uint64)
    plain = hashes.astype(np.uint64)
    for lo in range(0, len(plain), 256):
        least = np.minimum(least, ((plain[lo : lo + 256, None] ^ mask) * factor).min(0))
    four = (least * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(60)
    keys = [xxhash.xxh64_intdigest(least[k : k + BAND].tobytes(), k) for k in range(0, BANDS * BAND, BAND)]
    return _majority(iter([hashes.astype(">u8")])), (four[::2] | four[1::2] << np.uint64(4)).astype(np.uint8).tobytes(), keys


def unlike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many least hashes differ between sketches, each a row of numbers of 64 bits."""
    bits = a ^ b
    bits |= bits >> np.uint64(2)
    bits |= bits >> np.uint64(1)
    return np.bitwise_count(bits & np.uint64(0x1111111111111111)).sum(1, dtype=np.int64)


def most_unlike(similarity: float) -> int:
    """Least hashes that differ at most between sketches of sets of that similarity, of which
    one in 16 that differs looks the same."""
    return int(HASHES * (1 - similarity + SLACK) * 15 / 16)


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _fingerprints(words: int, seed: int, sketched: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        rows = 0
        for batch in batches:
            values, names = [row_numbers(rows, batch.num_rows), *batch.columns[2:]], ["row", *batch.schema.names[2:]]
            rows += batch.num_rows
            if sketched:
                made = [sketch(raw, words, seed) for raw in byte_rows(batch.column(1))]
                # texts with one fingerprint and one sketch are one node
                nodes = [xxhash.xxh64_intdigest(code + fp.to_bytes(8, "little")) for fp, code, _ in made]
                ends = pa.array(np.arange(len(made) + 1) * BANDS, pa.int32())
                keys = pa.ListArray.from_arrays(ends, _signed([key for _, _, keys in made for key in keys]))
                values = [_signed(nodes), *values, _signed([fp for fp, _, _ in made]), pa.array([code for _, code, _ in made], pa.binary()), keys]
                names = ["node", *names, "fp", "sketch", "bands"]
            else:
                values = [_signed([fingerprint(raw, words, seed) for raw in byte_rows(batch.column(1))]), *values]
                names = ["node", *names]
            yield pa.RecordBatch.from_arrays([batch.column(0), *values], ["id", *names])

    return run


def gray_rank(values: np.ndarray) -> np.ndarray:
    """Place of each value in the order of the reflected Gray code."""
    out = values.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(shift)
    return out


class GrayIndex:
    """Index of fingerprints that lie in several buckets; `links` finds pairs within buckets."""

    def __init__(self, bucket: np.ndarray, values: np.ndarray, sketches: np.ndarray | None = None, most: int = 0):
        """With sketches, only pairs of which no more than `most` least hashes differ are linked."""
        order = np.lexsort((gray_rank(values), bucket))
        self.order, self.values = order, values[order]
        self.sketches, self.most = None if sketches is None else sketches[order], most
        owner = bucket[order]
        #: of each level, leaves first: shared bits of a node, those not shared above, first child, end
        self.levels: list[dict[str, np.ndarray]] = []
        every = np.uint64(0xFFFFFFFFFFFFFFFF)
        mask, pattern = np.full(len(order), every), self.values
        first, end = np.arange(len(order)), np.arange(1, len(order) + 1)
        self.levels.append({"mask": mask, "pattern": pattern, "lo": first, "hi": end})
        while len(owner) and len(owner) > len(np.unique(owner)):
            starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            inside = np.arange(len(owner)) - np.repeat(starts, np.diff(np.append(starts, len(owner))))
            heads = np.flatnonzero(inside % FANOUT == 0)
            ones = np.bitwise_and.reduceat(np.where(mask, pattern & mask, 0), heads)
            zeros = np.bitwise_and.reduceat(~pattern & mask, heads)
            first, end = np.append(heads, len(owner))[:-1], np.append(heads, len(owner))[1:]
            below = self.levels[-1]
            parent = np.repeat(np.arange(len(heads)), end - first)
            mask, pattern, owner = ones | zeros, ones, owner[heads]
            below["mask"] = below["mask"] & ~mask[parent]
            self.levels.append({"mask": mask, "pattern": pattern, "lo": below["lo"][first], "hi": below["hi"][end - 1], "first": first, "end": end})
        self.root = np.searchsorted(owner, bucket[order]) if len(owner) else np.empty(0, np.int64)

    def links(self, distance: int) -> np.ndarray:
        """For each input row a row of its bucket that it is linked with over links of at most
        `distance` bits: the same one for all rows of a component."""
        label = np.arange(len(self.values))
        step = 64  # the first searches link dense groups, which later ones then skip
        at = 0
        while at < len(label):
            self._search(np.arange(at, min(at + step, len(label))), label, distance)
            at, step = at + step, min(2 * step, SEARCHES)
        out = np.empty_like(label)
        out[self.order] = self.order[label]
        return out

    def _search(self, rows: np.ndarray, label: np.ndarray, distance: int) -> None:
        top = len(self.levels) - 1
        spread = [label]  # of each level the label that all of a node's rows have, or -1
        for level in self.levels[1:]:
            low = np.minimum.reduceat(spread[-1], level["first"])
            high = np.maximum.reduceat(spread[-1], level["first"])
            spread.append(np.where(low == high, low, -1))
        roots = self.root[rows]
        work = [(top, rows, roots, self._differ(top, rows, roots))]
        while work:
            level, row, node, bits = work.pop()
            here = self.levels[level]
            ok = (bits <= distance) & (here["hi"][node] > row + 1) & (spread[level][node] != label[row])
            row, node, bits = row[ok], node[ok], bits[ok]
            if not len(row):
                continue
            if level == 0:
                if self.sketches is not None:
                    alike = self._alike(row, node)
                    row, node = row[alike], node[alike]
                _unite(label, row, node)
                continue
            many = len(row) * FANOUT
            if many > FRONTIER:
                half = len(row) // 2
                work += [(level, x[half:], y[half:], z[half:]) for x, y, z in [(row, node, bits)]]
                row, node, bits = row[:half], node[:half], bits[:half]
                if len(row) * FANOUT > FRONTIER:
                    work.append((level, row, node, bits))
                    continue
            count = here["end"][node] - here["first"][node]
            below = ranges(here["first"][node], count)
            row = np.repeat(row, count)
            work.append((level - 1, row, below, np.repeat(bits, count) + self._differ(level - 1, row, below)))

    def _alike(self, a: np.ndarray, b: np.ndarray, at_once: int = 1 << 16) -> np.ndarray:
        parts = [slice(lo, lo + at_once) for lo in range(0, len(a), at_once)]
        return np.concatenate([unlike(self.sketches[a[part]], self.sketches[b[part]]) <= self.most for part in parts])

    def _differ(self, level: int, row: np.ndarray, node: np.ndarray) -> np.ndarray:
        of = self.levels[level]
        return np.bitwise_count((self.values[row] ^ of["pattern"][node]) & of["mask"][node]).astype(np.int64)


def _unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give the rows of linked components the smallest of their labels, in place."""
    while True:
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        apart = low != high
        if not apart.any():
            return
        np.minimum.at(label, high[apart], low[apart])
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label[:] = jumped


def _bucket_links(distance: int, most: int | None, rows_at_once: int = 200_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(keys: np.ndarray, nodes: np.ndarray, values: np.ndarray, sketches: np.ndarray) -> pa.RecordBatch:
            index = GrayIndex(keys, values) if most is None else GrayIndex(keys, values, sketches, most)
            other = nodes[index.links(distance)]
            apart = other != nodes
            return pa.RecordBatch.from_arrays([pa.array(nodes[apart]), pa.array(other[apart])], ["a", "b"])

        held = None
        for batch in batches:
            keys, nodes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if most is None:
                new = (keys, nodes, nodes.view(np.uint64), np.empty((len(keys), 0), np.uint64))
            else:
                codes = np.frombuffer(b"".join(byte_rows(batch.column(3))), "<u8").reshape(len(keys), -1)
                new = (keys, nodes, batch.column(2).to_numpy().view(np.uint64), codes)
            held = new if held is None else tuple(map(np.concatenate, zip(held, new)))
            if len(held[0]) > rows_at_once:
                cut = int(np.searchsorted(held[0], held[0][-1]))  # the last bucket may go on
                if cut:
                    yield flush(*(x[:cut] for x in held))
                    held = tuple(x[cut:] for x in held)
        if held is not None and len(held[0]):
            yield flush(*held)

    return run


def _block_keys(distance: int):
    """For each of the blocks of bits: its number and its bits as one number."""
    edges = [64 * k // (distance + 1) for k in range(distance + 2)]
    blocks = []
    for k, (lo, hi) in enumerate(zip(edges, edges[1:])):
        bits = F.shiftrightunsigned("node", lo).bitwiseAND((1 << (hi - lo)) - 1)
        blocks.append(F.lit(k << 33).cast("long") + bits)
    return F.array(*blocks)


def fingerprint_links(classes: DataFrame, distance: int = DISTANCE, bucket_rows: int = BUCKET_ROWS, most: int | None = None) -> DataFrame:
    """Links (a, b) between distinct nodes that join up all of each component.

    A node is a fingerprint; with `most`, it has a fingerprint fp, a sketch and the keys of its bands."""
    if not 1 <= distance <= 31:
        raise ValueError("distance must be from 1 to 31")
    carried = ["node"] if most is None else ["node", "fp", "sketch"]
    keys = _block_keys(distance) if most is None else F.col("bands")
    blocks = classes.select(*carried, F.explode(keys).alias("block"))
    large = stored(blocks.groupBy("block").count().filter(F.col("count") > bucket_rows), "buckets")
    if large.isEmpty():
        dealt = blocks.select("block", F.lit(0).alias("i"), F.lit(0).alias("j"), *carried)
    else:
        # at most (distance + 1 or BANDS) * n / bucket_rows blocks are large; Spark broadcasts them if they are few
        split = F.coalesce(F.ceil(F.col("count") / F.lit(bucket_rows / 2)), F.lit(1)).cast("int")
        salted = blocks.join(large, "block", "left").select("block", *carried, split.alias("p"))
        salted = salted.withColumn("i", F.pmod(F.xxhash64("node"), F.col("p").cast("long")).cast("int"))
        salted = salted.select("block", *carried, "p", "i", F.explode(F.sequence(F.lit(0), F.col("p") - 1)).alias("k"))
        # with more than one part every pair of different parts meets
        salted = salted.filter((F.col("p") == 1) | (F.col("i") != F.col("k")))
        dealt = salted.select("block", F.least("i", "k").alias("i"), F.greatest("i", "k").alias("j"), *carried)
    keyed = dealt.select(F.xxhash64("block", "i", "j").alias("key"), *carried)
    times = distance + 1 if most is None else BANDS
    return keyed.repartition(*parts(classes, times), "key").sortWithinPartitions("key").mapInArrow(_bucket_links(distance, most), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of the links (a, b): label is the smallest node of its component.

    Each round takes the smallest label among neighbours and then the label of that label, so
    distances to the smallest node shrink at least by half. No link or label reaches the driver. A node
    of very many links and a label of very many nodes are joined where their rows lie (`hot_join`).
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = stored(both.distinct().select("a", F.col("b").alias("node")), "edges")
    hubs = hot_keys(edges, "node")
    labels = stored(edges.groupBy("node").agg(F.min("a").alias("n")).select("node", F.least("node", "n").alias("label")), "labels")
    while True:
        near = hot_join(edges, labels, "node", hubs).groupBy(F.col("a").alias("to")).agg(F.min("label").alias("seen"))
        hooked = labels.join(near, labels["node"] == near["to"]).select(
            "node", F.least("label", "seen").alias("mid"), (F.col("seen") < F.col("label")).alias("moved")
        )
        hooked = stored(hooked, "hooked")
        if hooked.filter("moved").isEmpty():
            forget(edges, hooked)
            return labels
        target = hooked.select(F.col("node").alias("mid"), F.col("mid").alias("next"))
        jumped = hot_join(hooked.select("node", "mid"), target, "mid", hot_keys(hooked, "mid"))
        passed = stored(jumped.select("node", F.least("mid", "next").alias("label")), "labels")
        forget(labels, hooked)
        labels = passed


def near_duplicates(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = SHINGLE,
    distance: int | None = None,
    bucket_rows: int | None = None,
    keep: tuple[str, ...] = (),
    similarity: float | None = None,
) -> DataFrame:
    """One row per input row: the id column, fingerprint (16 hex digits), component_id, kept, then the columns in `keep`.

    component_id is the smallest id that can be reached over links of at most `distance` bits, the
    row's own included. With a similarity, links are those of a Jaccard similarity of the sets of
    shingles of so much, as sketches estimate it, and fingerprints are those of the sets; `distance`
    is then what the index lets pass. Null, empty and blank texts have fingerprint zero and are linked
    like any other. Null ids are never the smallest; a component of null ids alone has a null
    component_id. One row of each component is kept, with the smallest id; of several with that id, any
    one. Repeated rows give a row each, an empty table none; other columns are not read.
    """
    ship(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    own = [f"k{i}" for i in range(len(keep))]
    narrow = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *(F.col(c).alias(k) for c, k in zip(keep, own)))
    more = "".join(f", {k} {df.schema[c].dataType.simpleString()}" for c, k in zip(keep, own))
    if similarity is not None:
        distance, bucket_rows, most = distance or FAR, bucket_rows or SKETCH_ROWS, most_unlike(similarity)
        more += ", fp long, sketch binary, bands array<long>"
    else:
        distance, bucket_rows, most = distance or DISTANCE, bucket_rows or BUCKET_ROWS, None
    docs = stored(spread(narrow).mapInArrow(_fingerprints(words, SEED, most is not None), f"id {kind}, node long, row long{more}"), "fingerprints")
    first = F.struct(F.col("id").isNull().alias("a"), F.col("id").alias("b"), F.col("row").alias("c"))
    # rows of one node have one fingerprint, sketch and bands
    carried = [] if most is None else [F.first(c).alias(c) for c in ("fp", "sketch", "bands")]
    classes = stored(docs.groupBy("node").agg(F.min(first).alias("least"), *carried), "classes")
    links = stored(fingerprint_links(classes, distance, bucket_rows, most), "links")
    labels = components(links)

    member = stored(labels.join(classes.select("node", "least"), "node"), "members")
    smallest = stored(member.groupBy("label").agg(F.min("least").alias("whole")), "smallest")
    joined = hot_join(member.select("node", "label"), smallest, "label", hot_keys(member, "label")).select("node", "whole")
    resolved = classes.select("node", "least").join(joined, "node", "left").select("node", F.coalesce("whole", "least").alias("first"))
    resolved = stored(resolved, "resolved")
    forget(links, labels, member, smallest, classes)
    decided = docs.select("id", "node", "row", F.col("node" if most is None else "fp").alias("print"), *own)
    return hot_join(decided, resolved, "node", hot_keys(docs, "node")).select(
        F.col("id").alias(id_col),
        F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"),
        F.col("first.b").alias("component_id"),
        (F.col("row") == F.col("first.c")).alias("kept"),
        *(F.col(k).alias(c) for c, k in zip(keep, own)),
    )
