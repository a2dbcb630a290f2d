"""SentencePiece encoding and decoding for merge-type (BPE) models.

Merging always joins the neighbouring symbols whose union has the best score, so an encoding is the
one sequence of reachable pieces in which every neighbouring pair stays apart when merged alone.
Each prefix of a word therefore has a unique last piece: of the pieces that an automaton finds to
end there, the one that is compatible with the last piece of what stands before it. The table of
last pieces is filled from left to right and the ids are recovered from its end backwards.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import Memo, ship, spread

MODEL = "piece_bpe_32k.model"
#: Fixed values of the model format: the mark of a space, and the types of pieces.
SPACE, NORMAL, UNKNOWN, CONTROL, USER, BYTE = "▁", 1, 2, 3, 4, 6


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Number and value of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        raw = data[at : at + size]
        at += size
        yield key >> 3, struct.unpack("<f", raw)[0] if kind == 5 else raw


def read_model(path: str) -> tuple[list[tuple[str, float, int]], dict, dict]:
    """Pieces (text, score, type), and the fields of the trainer's and the normaliser's settings."""
    pieces, trainer, normalizer = [], {}, {}
    with open(path, "rb") as file:
        for number, value in _fields(file.read()):
            if number == 1:
                of = dict(_fields(value))
                pieces.append((of[1].decode(), of.get(2, 0.0), of.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normalizer = dict(_fields(value))
    return pieces, trainer, normalizer


class MergeModel:
    """A merge-type model with an identity normaliser, whole-word pieces and byte fallback."""

    def __init__(self, path: str):
        import ahocorasick

        pieces, trainer, normalizer = read_model(path)
        if trainer.get(3) != 2 or not trainer.get(35) or normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(3, 1):
            raise ValueError("not a merge-type model with identity normaliser, dummy prefix and byte fallback")
        self.pieces = pieces
        self.score = {text: score for text, score, kind in pieces if kind == NORMAL}
        self.id = {text: k for k, (text, _, kind) in enumerate(pieces) if kind == NORMAL}
        self.bytes = {int(text[1:-1], 16): k for k, (text, _, kind) in enumerate(pieces) if kind == BYTE}
        self.byte_of = {k: b for b, k in self.bytes.items()}
        inner = [p for p in self.score if SPACE in p.lstrip(SPACE) or (p.startswith(SPACE * 2) and p.strip(SPACE))]
        ranked = [s for p, s in self.score.items() if p.strip(SPACE)]
        self.runs = {len(p) for p in self.score if not p.strip(SPACE)}
        of_runs = {s for p, s in self.score.items() if not p.strip(SPACE) and len(p) > 1}
        if inner or len(set(ranked)) < len(ranked) or any(kind == USER for _, _, kind in pieces):
            raise ValueError("pieces must not reach over words or share a score")
        if SPACE not in self.score or len(of_runs) > 1 or of_runs and ranked and max(of_runs) >= min(ranked):
            raise ValueError("pieces of space marks must score alike and least")
        self.text = ["" if kind == CONTROL else " ⁇ " if kind == UNKNOWN else text.replace(SPACE, " ") for text, _, kind in pieces]
        self.number = [str(k) for k in range(len(pieces))]
        self.spines = {text: self._spines(text) for text in self.score if not text.startswith(SPACE * 2)}
        self.spines = {text: found for text, found in self.spines.items() if found}
        self.pair_spines = {self.id[text]: found for text, found in self.spines.items()}
        self.automaton = ahocorasick.Automaton()
        for text in self.spines:
            self.automaton.add_word(text, self.id[text])
        self.size = [len(text) for text, _, _ in pieces]
        self.automaton.make_automaton()
        self.compatible = Memo(self._apart)
        self.word = Memo(self._word)

    def _spines(self, piece: str) -> tuple[list, list] | None:
        """What stands at the left end and at the right end of a piece while it is merged, with scores
        from the second on; None if merging its characters doesn't give it, so no text has it."""
        if len(piece) == 1:
            return [(piece, 0.0)], [(piece, 0.0)]
        parts, left, right = list(piece), [(piece[0], 0.0)], [(piece[-1], 0.0)]
        while len(parts) > 1:
            at, score = self._best(parts)
            if at < 0:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            if at == 0:
                left.append((parts[0], score))
            if at == len(parts) - 1:
                right.append((parts[-1], score))
        for spine in (left, right):
            if any(a[1] <= b[1] for a, b in zip(spine[1:], spine[2:])):
                raise ValueError(f"{piece} scores better than a piece it is merged from")
        return left, right

    def _apart(self, pair: int) -> bool:
        """Whether two neighbouring pieces stay apart: no symbol at the end of the first is merged with
        one at the start of the second before either is merged inwards."""
        first, second = divmod(pair, len(self.pieces))
        ends, starts = self.pair_spines[first][1], self.pair_spines[second][0]
        i = j = 0
        while True:
            inner = ends[i + 1][1] if i + 1 < len(ends) else None
            outer = starts[j + 1][1] if j + 1 < len(starts) else None
            across = self.score.get(ends[i][0] + starts[j][0])
            if across is not None and (inner is None or across > inner) and (outer is None or across >= outer):
                return False
            if inner is None and outer is None:
                return True
            if outer is None or (inner is not None and inner >= outer):
                i += 1
            else:
                j += 1

    def _best(self, parts: list[str]) -> tuple[int, float]:
        best, at = -float("inf"), -1
        for k in range(len(parts) - 1):
            score = self.score.get(parts[k] + parts[k + 1])
            if score is not None and score > best:
                best, at = score, k
        return at, best

    def merge(self, text: str) -> list[str]:
        """Encoding by its definition: merge the best pair, the leftmost of equal ones, until none is left."""
        parts = list(text)
        while len(parts) > 1:
            at, _ = self._best(parts)
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def split(self, word: str) -> list[int]:
        """Ids of a space mark and the characters after it.

        last holds the last piece of each prefix, -1 where a character without a piece ends it.
        """
        last = [-1] * (len(word) + 1)
        compatible, size, n = self.compatible, self.size, len(self.pieces)
        for end, piece in self.automaton.iter(word):
            end += 1
            if last[end] < 0:
                before = last[end - size[piece]]
                if before < 0 or compatible[before * n + piece]:
                    last[end] = piece
        out, end = [], len(word)
        while end:
            piece = last[end]
            if piece < 0:
                out += [self.bytes[b] for b in reversed(word[end - 1].encode())]
                end -= 1
            else:
                out.append(piece)
                end -= size[piece]
        return out[::-1]

    def chunk(self, text: str) -> list[int]:
        """Ids of a run of space marks and the characters after it.

        Marks merge with each other only when nothing else merges, as those pieces score least.
        """
        marks = len(text) - len(text.lstrip(SPACE))
        if marks < 2:
            return self.split(text)
        body = self.split(text[marks - 1 :])
        if body[0] == self.id[SPACE]:
            body = body[1:]
        else:
            marks -= 1
        return [self.id[SPACE * n] for n in self.run(marks)] + body

    def run(self, marks: int) -> list[int]:
        """Lengths of the pieces of a run of space marks, which all score the same: the leftmost pair
        that makes a piece is merged first. What lies on the stack has no such pair."""
        stack: list[int] = []
        for _ in range(marks):
            stack.append(1)
            while len(stack) > 1 and stack[-2] + stack[-1] in self.runs:
                last = stack.pop()
                stack[-1] += last
        return stack

    def _word(self, part: str) -> tuple[str, str]:
        """Joined ids of a chunk, or of the characters after a single mark, and what they decode to.

        A chunk's first id is a piece of text, so no bytes are decoded together over two chunks."""
        ids = self.chunk(part) if part.startswith(SPACE) else self.split(SPACE + part)
        return ",".join([self.number[k] for k in ids]), self.decode_part(ids)

    def chunks(self, text: str) -> list[str]:
        """A text cut before each run of space marks; nothing merges over these cuts."""
        out, marks = [], 0
        for part in (SPACE + text.replace(" ", SPACE)).split(SPACE)[1:]:
            marks += 1
            if part:
                out.append(SPACE * marks + part)
                marks = 0
        return [*out, SPACE * marks] if marks else out

    def encode(self, text: str) -> list[int]:
        return [k for chunk in self.chunks(text) for k in self.chunk(chunk)] if text else []

    def decode_part(self, ids: list[int]) -> str:
        if self.byte_of.keys().isdisjoint(ids):
            return "".join([self.text[k] for k in ids])
        out, raw = [], bytearray()
        for k in ids:
            if k in self.byte_of:
                raw.append(self.byte_of[k])
                continue
            out += (_replaced(bytes(raw)), self.text[k])
            raw.clear()
        return "".join((*out, _replaced(bytes(raw))))

    def decode(self, ids: list[int]) -> str:
        """The text of any ids: without the first space, each byte that is no UTF-8 replaced."""
        start = next((k for k, i in enumerate(ids) if self.pieces[i][2] != CONTROL), len(ids))
        text = self.decode_part(ids[start:])
        return text[1:] if start < len(ids) and self.pieces[ids[start]][0].startswith(SPACE) else text

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the joined ids, SHA-256 of the text that is decoded from them."""
        if not text:
            return 0, _sha(""), _sha("")
        if "  " in text or SPACE in text or text[0] == " " or text[-1] == " ":
            parts = self.chunks(text)
        else:
            parts = text.split(" ")
        pairs = list(map(self.word.__getitem__, parts))
        joined = ",".join([ids for ids, _ in pairs])
        return joined.count(",") + 1, _sha(joined), _sha("".join([decoded for _, decoded in pairs])[1:])


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _replaced(raw: bytes) -> str:
    """UTF-8 text; every byte outside of a whole character becomes U+FFFD."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(raw):
            for size in (1, 2, 3, 4):
                try:
                    out.append(raw[at : at + size].decode())
                    at += size
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


@lru_cache(2)
def model(path: str = public_tokenizers.path(MODEL)) -> MergeModel:
    return MergeModel(path)


def _digests(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = model(path)
        for batch in batches:
            rows = [use.digest(value.as_py()) for value in batch.column(1)]
            n, ids, decoded = zip(*rows) if rows else ((), (), ())
            values = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(values, ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _encoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = model(path)
        for batch in batches:
            ids = [use.encode(value.as_py() or "") for value in batch.column(1)]
            text = [use.decode(x) for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(text, pa.string())], ["id", "ids", "decoded"])

    return run


def _narrow(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    ship(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    return spread(df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))), kind


def sentencepiece_ids(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = public_tokenizers.path(MODEL)) -> DataFrame:
    """Ids of each text and the text decoded from them: the id column, ids, decoded.

    A null or empty text has no ids. Repeated rows give a row each, an empty table none; other
    columns are not read.
    """
    narrow, kind = _narrow(df, id_col, text_col)
    return narrow.mapInArrow(_encoded(path), f"id {kind}, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def sentencepiece_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = public_tokenizers.path(MODEL)) -> DataFrame:
    """As `sentencepiece_ids`, with digests in place of ids and text: n_tokens, ids_sha256, decoded_sha256."""
    narrow, kind = _narrow(df, id_col, text_col)
    out = narrow.mapInArrow(_digests(path), f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col)
