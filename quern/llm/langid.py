"""Language identification by error-correcting output codes.

Each language has a codeword; a binary classifier over hashed byte n-grams predicts each bit. A text
gets the language whose codeword has the least logistic loss under the predicted margins, so a
few wrong bits don't change it. A text is flagged as ambiguous whose best two codewords lie too close, or
whose nearest codeword lies far off, as for a language that was never learned.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import LETTER, forget, ship, spread, stored

#: Labelled rows of each language that a model is fitted on at most (about; chosen by a hash of the id).
TRAIN_ROWS = 1000
#: Rows of a sample as a whole (the driver holds twice as many at most, 8 kB each; more than 16 languages
#: share them), and languages: more labels are an error.
SAMPLE_ROWS, MOST = 16_000, 10_000
#: n-gram buckets, steps of fitting and their penalty.
BUCKETS, STEPS, PENALTY = 2048, 150, 1e-3
#: Rows whose crc32(id as text) leaves this remainder are held out.
FOLDS, HELD_OUT = 4, 2
#: A prediction is ambiguous if its score is less than CLEAR, or its mean loss of a bit FAR or more (a guess: 0.69).
CLEAR, FAR, UNKNOWN = 0.6, 0.4, "und"
BLOCK = 1 << 20


def has_letter(text: str) -> bool:
    return any(found.group().isalpha() for found in LETTER.finditer(text))


def features(text: str) -> np.ndarray:
    """Square roots of the shares of hashed byte 1-, 2- and 3-grams of the lower-cased text."""
    data = np.frombuffer(b" " + text.lower().encode() + b" ", np.uint8)
    counts = np.zeros(BUCKETS)
    shift = np.uint32(32 - (BUCKETS.bit_length() - 1))
    for lo in range(0, len(data), BLOCK):
        a = data[lo : lo + BLOCK + 2].astype(np.uint32)
        two = (a[:-1] << np.uint32(8)) | a[1:]
        three = (two[:-1] << np.uint32(8)) | a[2:]
        for salt, grams in enumerate((a[:BLOCK], two[:BLOCK] + np.uint32(1 << 24), three[:BLOCK] + np.uint32(2 << 24))):
            counts += np.bincount((grams * np.uint32(0x9E3779B1)) >> shift, minlength=BUCKETS)
    return np.sqrt(counts / max(counts.sum(), 1)).astype(np.float32)


def codewords(languages: int, seed: int = 7) -> np.ndarray:
    """A codeword of -1 and 1 for each language: all ways to part up to 6 of them, else random ones
    of which the tries keep those farthest apart."""
    if languages < 2:
        return np.ones((languages, 0))
    if languages <= 6:
        rest = [bits for bits in product((-1, 1), repeat=languages - 1) if set(bits) != {1}]
        return np.array([(1, *bits) for bits in rest]).T.astype(float)
    rng, length = np.random.default_rng(seed), int(np.ceil(10 * np.log2(languages)))
    best, apart = None, -1
    for _ in range(50):
        code = rng.choice([-1.0, 1.0], (languages, length))
        gap = length
        for lo in range(0, languages, 1000):
            near = (length - code[lo : lo + 1000] @ code.T) / 2
            near[np.arange(len(near)), np.arange(lo, lo + len(near))] = length
            gap = min(gap, near.min())
        if gap > apart and (np.abs(code.sum(0)) < languages).all():
            best, apart = code, gap
    return best


class CodeClassifier:
    """Bits of codewords by logistic regression on n-gram shares (x is changed); decoding by least loss."""

    def __init__(self, x: np.ndarray, y: np.ndarray, languages: list[str]):
        self.languages, self.code = languages, codewords(len(languages))
        self.mean = x.mean(0, dtype=np.float64).astype(np.float32) if len(x) else np.zeros(BUCKETS, np.float32)
        self.weight = np.zeros((BUCKETS, self.code.shape[1]), np.float32)
        self.bias = np.zeros(self.code.shape[1], np.float32)
        if not self.code.shape[1]:
            return
        target = self.code[y].astype(np.float32)
        each = (1.0 / np.bincount(y, minlength=len(languages))[y] / len(languages)).astype(np.float32)[:, None]
        z = x  # centred in place: the sample is the largest thing that the driver holds
        z -= self.mean
        rate, momentum = 4.0 / max(float(each[:, 0] @ np.einsum("ij,ij->i", z, z)), 1e-9), 0.9
        step_w, step_b = np.zeros_like(self.weight), np.zeros_like(self.bias)
        for _ in range(STEPS):
            margin = (z @ self.weight + self.bias) * target
            slope = -each * target / (1 + np.exp(np.clip(margin, -30, 30)))
            step_w = momentum * step_w - rate * (z.T @ slope + PENALTY * self.weight)
            step_b = momentum * step_b - slope.sum(0)
            self.weight += step_w
            self.bias += step_b

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language with the least loss (the first of equal ones), its score, and whether it
        is ambiguous."""
        margin = np.clip((x - self.mean) @ self.weight + self.bias, -30, 30).astype(np.float64)
        loss = np.log1p(np.exp(-margin)) @ (self.code > 0).T.astype(float) + np.log1p(np.exp(margin)) @ (self.code < 0).T.astype(float)
        share = np.exp(loss.min(1, keepdims=True) - loss)
        score = share.max(1) / share.sum(1)
        return loss.argmin(1), score, (score < CLEAR) | (loss.min(1) >= FAR * max(self.code.shape[1], 1))


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [k for k, value in enumerate(batch.column(1)) if value.is_valid and has_letter(value.as_py())]
        rows = [features(batch.column(1)[k].as_py()).astype(np.float16).tobytes() for k in keep]
        take = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(2).take(take), pa.array(rows, pa.binary())], ["id", "lang", "x"])


def _languages(model: CodeClassifier, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
    known = [k for k, text in enumerate(texts) if text is not None and model.languages and has_letter(text)]
    lang, score, unclear = [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
    if known:
        for k, best, share, doubt in zip(known, *model.predict(np.stack([features(texts[k]) for k in known]))):
            lang[k], score[k], unclear[k] = model.languages[best], float(share), bool(doubt)
    return lang, score, unclear


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                lang, score, unclear = _languages(shared.value, part.column(1).to_pylist())
                values = [part.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(unclear, pa.bool_())]
                yield pa.RecordBatch.from_arrays(values, ["id", "lang_pred", "score", "ambiguous"])

    return run


def _identified(shared, text_at: int, wanted: frozenset[str] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                texts = part.column(text_at).to_pylist()
                if shared.value.languages:
                    found, _, unclear = _languages(shared.value, texts)
                    keep = [not doubt and (wanted is None or lang in wanted) for lang, doubt in zip(found, unclear)]
                else:  # nothing was learned, which is no fault of a text
                    keep = [text is not None and has_letter(text) for text in texts]
                yield part.filter(pa.array(keep, pa.bool_()))

    return run


def _remainder(column: str) -> Column:
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % FOLDS


def fit_languages(df: DataFrame, id_col: str, text_col: str, lang_col: str, train_rows: int) -> CodeClassifier:
    """A classifier fitted on train_rows or so of each language's rows that are not held out, and SAMPLE_ROWS
    or so in all. All labels are learned, or too many raise ValueError."""
    ship(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    narrow = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    known = narrow.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (_remainder("id") != HELD_OUT))
    counts = stored(known.groupBy("lang").count(), "labels")
    found = counts.count()
    if found > MOST:
        raise ValueError(f"{found} different labels in {lang_col}; {MOST} languages at most can be learned")
    total = min(train_rows * found, SAMPLE_ROWS)
    share = F.least(F.lit(1.0), F.lit(float(total)) / F.lit(max(found, 1)) / F.col("count"))
    draw = F.pmod(F.xxhash64("id", "lang"), F.lit(1_000_000)) < share * 1_000_000
    drawn = spread(known).join(F.broadcast(counts), "lang").filter(draw).select("id", "text", "lang")
    sample = stored(drawn.mapInArrow(_sample, f"id {kind}, lang string, x binary"), "languages")
    train = sample.orderBy("lang", "id").limit(2 * max(total, 1)).select("lang", "x").toArrow()
    names = train["lang"].to_pylist()
    languages = sorted(set(names))
    place = {name: k for k, name in enumerate(languages)}
    y = np.array([place[name] for name in names], np.int64)
    x = np.empty((len(names), BUCKETS), np.float32)
    for k, row in enumerate(train["x"]):
        x[k] = np.frombuffer(row.as_buffer(), np.float16)
    del train
    forget(counts, sample)
    return CodeClassifier(x, y, languages)


def identify_language(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_rows: int = TRAIN_ROWS
) -> DataFrame:
    """The id column, held_out, lang_pred, score (0 to 1) and ambiguous of each row.

    Rows that are not held out teach if their language is known and their text has a letter. A
    null text, one without letters, or any text where nothing was learned is `und` with score 0 and
    ambiguous. With one language learned, all other texts have it. Equal losses give the language first in
    alphabetical order. Repeated rows give a row each, an empty table none; other columns are not read.
    """
    kind = df.schema[id_col].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(fit_languages(df, id_col, text_col, lang_col, train_rows))
    narrow = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = spread(narrow).mapInArrow(_predict(shared), f"id {kind}, lang_pred string, score double, ambiguous boolean")
    return out.select(F.col("id").alias(id_col), (_remainder("id") == HELD_OUT).alias("held_out"), "lang_pred", "score", "ambiguous")


def identified_rows(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    train_rows: int = TRAIN_ROWS,
    languages: Iterable[str] | None = None,
) -> DataFrame:
    """The rows of df that `identify_language` gives one of the languages (None: any learned one) without
    doubt, with all of their columns, in one pass without a shuffle. Ambiguous rows go: texts between
    two languages, in none that was learned, or too short to tell. Where no language was learned, all
    rows whose text has a letter stay. An empty table gives none."""
    wanted = None if languages is None else frozenset(languages)
    shared = df.sparkSession.sparkContext.broadcast(fit_languages(df, id_col, text_col, lang_col, train_rows))
    return spread(df).mapInArrow(_identified(shared, df.columns.index(text_col), wanted), df.schema)
