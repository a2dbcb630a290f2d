"""Quality of documents by gradient-boosted trees over histograms of their statistics.

Trees are grown on the driver from binned statistics of a bounded sample of labelled rows, and
flattened into arrays: node k of a tree has children 2k + 1 and 2k + 2, so all trees are walked at
once, level by level, for a batch. Scoring is one pass over the texts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from operator import eq
from unicodedata import category

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import forget, ship, spread, stored

#: Labelled rows that a model is fitted on at most (about; rows are chosen by a hash of their id).
TRAIN_ROWS = 20_000
TREES, DEPTH, BINS, RATE, L2 = 60, 4, 64, 0.2, 1.0
#: Rows whose crc32(id as text) leaves this remainder are held out.
FOLDS, HELD_OUT = 3, 1

#: General categories of Unicode, and the kinds that words are told apart by.
CATEGORIES = "Lu Ll Lt Lm Lo Mn Mc Me Nd Nl No Pc Pd Ps Pe Pi Pf Po Sm Sc Sk So Zs Zl Zp Cc Cf Cs Co Cn".split()
KINDS = "LNPS"
STATISTICS = (
    *CATEGORIES, "log_chars", "capitals", "capital_pairs", "entropy", "repeats", "runs", "longest_run", "log_words", "word_chars", "distinct_words",
    "most_frequent_word", "repeated_words", "bare_words", "capital_starts", *(f"starts_{k}" for k in KINDS), *(f"ends_{k}" for k in KINDS),
    "marks_a_word", "repeated_lines", "line_chars", "line_ends_P",
)
BLOCK = 1 << 20


@lru_cache(1)
def _categories() -> np.ndarray:
    """The place in CATEGORIES of each code point's category; len(CATEGORIES) for ASCII white space."""
    place = {name: k for k, name in enumerate(CATEGORIES)}
    table = np.array([place[category(chr(c))] for c in range(0x110000)], np.uint8)
    table[[9, 10, 11, 12, 13, 32]] = len(CATEGORIES)
    return table


def statistics(text: str) -> list[float]:
    """The numbers named in STATISTICS. None of them knows a word, a language or a single character
    (but for white space): categories of characters, runs, entropy, words, lines and their repetition."""
    blank, of = len(CATEGORIES), _categories()
    seen, starts, ends, pairs = np.zeros(blank + 1), np.zeros(blank + 1), np.zeros(blank + 1), 0
    same = in_runs = run = longest = 0
    last_code, last_kind = -1, blank
    by_byte = np.zeros(256)
    for lo in range(0, len(text), BLOCK):
        part = text[lo : lo + BLOCK]
        by_byte += np.bincount(np.frombuffer(part.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
        code = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        kind = of[code]
        seen += np.bincount(kind, minlength=blank + 1)
        before = np.concatenate(([last_kind], kind[:-1]))
        starts += np.bincount(kind[(before == blank) & (kind != blank)], minlength=blank + 1)
        ends += np.bincount(before[(before != blank) & (kind == blank)], minlength=blank + 1)
        pairs += int(((kind == 0) & (before == 0)).sum())
        # runs of one character other than white space, a run over two blocks included
        equal = (code == np.concatenate(([last_code], code[:-1]))) & (kind != blank)
        same += int(equal.sum())
        heads = np.flatnonzero(~equal)
        sizes = np.diff(np.append(heads, len(code))) if len(heads) else np.empty(0, np.int64)
        if len(heads) == 0 or heads[0]:
            more = int(heads[0]) if len(heads) else len(code)
            in_runs += (run + more if run < 3 else more) if run + more >= 3 else 0
            run += more
            longest = max(longest, run)
        solid = sizes[kind[heads] != blank]
        in_runs += int(solid[solid >= 3].sum())
        longest = max(longest, int(solid.max(initial=0)))
        if len(heads):
            run = int(sizes[-1]) if kind[-1] != blank else 0
        last_code, last_kind = int(code[-1]), int(kind[-1])
    if last_kind != blank:
        ends[last_kind] += 1
    words, lines = text.split(), text.split("\n")
    n, many, total, letters = max(len(text), 1), max(len(words), 1), max(starts.sum(), 1), max(seen[:5].sum(), 1)
    solid = max(n - seen[blank], 1)
    share = by_byte[by_byte > 0] / max(by_byte.sum(), 1)
    counts = Counter(words)
    major = np.array([[c[0] == k for c in CATEGORIES] + [False] for k in KINDS], float)
    marks = seen @ major[2:].T
    bare = sum(count for word, count in counts.items() if not any(map(str.isalnum, word))) if starts[11:22].any() else 0
    line_ends = [line[-1] for line in map(str.rstrip, lines) if line]
    return [
        *(seen[:blank] / n), np.log1p(len(text)), seen[0] / letters, pairs / letters, float(-(share * np.log(share)).sum()), same / solid, in_runs / solid, np.log1p(longest),
        np.log1p(len(words)), solid / many, len(counts) / many, max(counts.values(), default=0) / many, sum(map(eq, words, words[1:])) / many, bare / many,
        starts[0] / total, *(major @ starts / total), *(major @ ends / total), marks.sum() / many,
        1 - len(set(lines)) / len(lines), np.log1p(n / len(lines)), sum(category(c)[0] == "P" for c in line_ends) / max(len(line_ends), 1),
    ]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [np.array(statistics(value.as_py() or ""), np.float32).tobytes() for value in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(rows, pa.binary())], ["id", "y", "x"])


class BoostedTrees:
    """A binary classifier; without any rows, or with rows of one class, its score is constant."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        prior = (y.sum() + 1.0) / (len(y) + 2.0)
        self.base = float(np.log(prior / (1 - prior))) if len(y) else 0.0
        inner, leaves = (1 << DEPTH) - 1, 1 << DEPTH
        trees = TREES if 0 < y.sum() < len(y) else 0
        self.feature = np.zeros((trees, inner), np.int64)
        self.threshold = np.full((trees, inner), np.inf)
        self.leaf = np.zeros((trees, leaves))
        if not trees:
            return
        edges = [np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for column in x.T]
        width = x.shape[1]
        codes = np.stack([np.searchsorted(e, column, "left") for e, column in zip(edges, x.T)], 1)
        cell = codes + np.arange(width) * BINS
        rows, score = np.arange(len(y)), np.full(len(y), self.base)
        for t in range(trees):
            p = 1 / (1 + np.exp(-score))
            slope, curve = p - y, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            for level in range(DEPTH):
                own = 1 << level
                flat = (cell + (node * width * BINS)[:, None]).ravel()
                g, h = (np.bincount(flat, np.repeat(v, width), own * width * BINS).reshape(own, width, BINS) for v in (slope, curve))
                g, h = g.cumsum(2), h.cumsum(2)
                all_g, all_h = g[:, :1, -1:], h[:, :1, -1:]
                gain = g**2 / (h + L2) + (all_g - g) ** 2 / (all_h - h + L2) - all_g**2 / (all_h + L2)
                for f in range(width):
                    gain[:, f, len(edges[f]) :] = 0
                best = gain.reshape(own, -1).argmax(1)
                f, b = best // BINS, best % BINS
                good = gain.reshape(own, -1)[np.arange(own), best] > 1e-6
                at = own - 1 + np.arange(own)
                self.feature[t, at] = f
                self.threshold[t, at] = [edges[i][j] if ok else np.inf for i, j, ok in zip(f, b, good)]
                node = 2 * node + (x[rows, f[node]] > self.threshold[t, at][node])
            g, h = (np.bincount(node, v, leaves) for v in (slope, curve))
            self.leaf[t] = -RATE * g / (h + L2)
            score += self.leaf[t][node]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row."""
        trees = np.arange(len(self.leaf))
        node = np.zeros((len(x), len(trees)), np.int64)
        rows = np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            right = x[rows, self.feature[trees, node]] > self.threshold[trees, node]
            node = 2 * node + 1 + right
        raw = self.base + self.leaf[trees, node - ((1 << DEPTH) - 1)].sum(1)
        return 1 / (1 + np.exp(-raw))


def _matrix(rows: list) -> np.ndarray:
    return np.array(rows, np.float32).reshape(len(rows), len(STATISTICS)).astype(np.float64)


def _scores(model: BoostedTrees, column: pa.Array) -> np.ndarray:
    return model.score(_matrix([statistics(value.as_py() or "") for value in column]))


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(_scores(shared.value, part.column(1)))], ["id", "score"])

    return run


def _good(shared, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                yield part.filter(pa.array(_scores(shared.value, part.column(text_at)) >= 0.5))

    return run


def _remainder(column: str) -> Column:
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % FOLDS


def fit_quality(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, train_rows: int) -> BoostedTrees:
    """Trees fitted on the labelled rows that are not held out, or on train_rows of them or so."""
    ship(df.sparkSession)
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter("y in (0, 1)")
    known = known.filter(F.col("id").isNotNull() & (_remainder("id") != HELD_OUT)).groupBy("id").agg(F.max("y").alias("y"))
    share = min(1.0, train_rows / max(known.count(), 1))
    chosen = known.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < share * 1_000_000).limit(2 * train_rows)
    kind = df.schema[id_col].dataType.simpleString()
    # at most 2 * train_rows ids and labels are broadcast, so that no text is shuffled
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "id")
    measured = stored(spread(texts).select("id", "text", "y").mapInArrow(_measure, f"id {kind}, y int, x binary"), "statistics")
    sample = measured.groupBy("id").agg(F.min("x").alias("x"), F.first("y").alias("y")).orderBy("id").toPandas()
    forget(measured)
    return BoostedTrees(_matrix([np.frombuffer(x, np.float32) for x in sample["x"]]), sample["y"].to_numpy(np.float64))


def quality(
    df: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    train_rows: int = TRAIN_ROWS,
) -> DataFrame:
    """The id column, held_out, score (0 to 1) and predicted (score of 0.5 or more) of each row.

    labels has the id column and label_col (0 or 1; others and nulls teach nothing; of several the
    greatest holds). Only rows that are not held out teach; of rows with one id, one does. A null text counts as empty and is scored like any other. Without
    labels every score is 0.5. Repeated rows give a row each, an empty table none; other
    columns are not read.
    """
    kind = df.schema[id_col].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(fit_quality(df, labels, id_col, text_col, label_col, train_rows))
    narrow = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return spread(narrow).mapInArrow(_score(shared), f"id {kind}, score double").select(
        F.col("id").alias(id_col), (_remainder("id") == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def good_rows(
    df: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    train_rows: int = TRAIN_ROWS,
) -> DataFrame:
    """The rows of df that `quality` predicts 1 for, with all of their columns, in one pass without a shuffle."""
    shared = df.sparkSession.sparkContext.broadcast(fit_quality(df, labels, id_col, text_col, label_col, train_rows))
    return spread(df).mapInArrow(_good(shared, df.columns.index(text_col)), df.schema)
