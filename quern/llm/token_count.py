"""Token counts under a unigram vocabulary, without making the tokens.

An Aho-Corasick automaton enumerates every piece that ends at each character of a word. Dynamic
programming carries the score and the number of ids of the best path to each position; nothing is
kept from which the path could be read. Of paths with equal scores the one whose last piece
starts first wins, a piece before an unknown character, as in the tokenizers library's unigram
model, whose word splitting (a mark before each word) is used too.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import Memo, ship, spread
from quern.llm.spm import BYTE, MODEL, NORMAL, SPACE, read_model

#: Fixed value of the library: what an unknown character scores below the worst piece.
UNKNOWN_PENALTY = 10.0


class UnigramCounter:
    """Counts ids of texts. vocabulary: pieces and scores; with byte_fallback an unknown character
    counts its UTF-8 bytes, else a run of unknown characters counts one."""

    def __init__(self, vocabulary: list[tuple[str, float]], byte_fallback: bool = True):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {piece for piece, _ in vocabulary if len(piece) == 1}
        self.unknown = min((score for _, score in vocabulary), default=0.0) - UNKNOWN_PENALTY
        self.byte_fallback = byte_fallback
        self.word = Memo(lambda part: self.path(SPACE + part))

    def path(self, word: str) -> tuple[int, float]:
        """Number of ids and score of the best path through a word."""
        if not self.single.issuperset(word):
            return self._path_with_unknown(word)
        score: list[float | None] = [None] * (len(word) + 1)
        count = [0] * (len(word) + 1)
        score[0] = 0.0
        for end, (size, own) in self.automaton.iter(word):  # of one end the longest piece comes first
            end += 1
            reached, start = score[end], end - size
            own += score[start]
            if reached is None or own > reached:
                score[end] = own
                count[end] = count[start] + 1
        return count[-1], score[-1]

    def _path_with_unknown(self, word: str) -> tuple[int, float]:
        ending: list[list[tuple[int, float]]] = [[] for _ in range(len(word) + 1)]
        for end, piece in self.automaton.iter(word):
            ending[end + 1].append(piece)
        best = [(0.0, 0, False)]  # score, ids, ends in an unknown character
        for end in range(1, len(word) + 1):
            found = None
            for size, own in ending[end]:
                score, count, _ = best[end - size]
                if found is None or score + own > found[0]:
                    found = (score + own, count + 1, False)
            character = word[end - 1]
            if character not in self.single:
                score, count, unknown = best[end - 1]
                if found is None or score + self.unknown > found[0]:
                    more = len(character.encode()) if self.byte_fallback else int(not unknown)
                    found = (score + self.unknown, count + more, True)
            best.append(found)
        return best[-1][1], best[-1][0]

    def count(self, text: str | None) -> tuple[int, float]:
        """Number of ids and total score of a text; nothing for a null or empty one."""
        if not text:
            return 0, 0.0
        marked = text.replace(" ", SPACE)
        parts = marked[marked.startswith(SPACE) :].split(SPACE)
        counts, scores = zip(*map(self.word.__getitem__, parts))
        return sum(counts), float(sum(scores))


@lru_cache(2)
def counter(path: str = public_tokenizers.path(MODEL)) -> UnigramCounter:
    """The normal pieces of a model file and their scores, read as a unigram vocabulary."""
    pieces = read_model(path)[0]
    return UnigramCounter([(text, score) for text, score, kind in pieces if kind == NORMAL], any(kind == BYTE for _, _, kind in pieces))


def _counts(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = counter(path)
        for batch in batches:
            rows = [use.count(value.as_py()) for value in batch.column(1)]
            n, score = zip(*rows) if rows else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(score, pa.float64())], ["id", "n_tokens", "score"])

    return run


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = public_tokenizers.path(MODEL)) -> DataFrame:
    """The id column, n_tokens and score of the best path of each whole text.

    A null or empty text has 0 tokens and score 0. Repeated rows give a row each, an empty table
    none; other columns are not read.
    """
    ship(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    narrow = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return spread(narrow).mapInArrow(_counts(path), f"id {kind}, n_tokens long, score double").withColumnRenamed("id", id_col)
