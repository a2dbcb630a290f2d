"""Main text of web pages by a recurrent block labeller.

A page is cut into blocks: runs of text between tags that start or end a block. Each block becomes a
vector of its hashed tag path (tags, classes, ids and roles of what is open), of its hashed words and
of a few numbers. A bidirectional LSTM reads the blocks of a page in order, so what a block is
taken for depends on all others. It was trained here, on generated pages of many layouts
(`train_labeller.py`), and runs as numpy over groups of pages of similar length.

A page takes time in proportion to its length: what the open elements add up to is kept up to date
tag by tag. Blocks with equal paths share one path vector, and a long page is read in chunks
of which only the network's state and one number for each block are kept.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from itertools import chain
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import Memo, ship, slices, spread

#: Fixed values of the format: elements that start a block, hold no content, or hold raw text.
BLOCKS = frozenset(
    """address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption
    figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript ol
    optgroup option p pre search section select summary table tbody td template textarea tfoot th thead title tr ul""".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("script style".split())
SECTIONS = frozenset("article aside footer form header main nav section".split())
#: A start tag closes what stands here if it is open inside of the second set.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"}),
}
IN_P = frozenset({"button", "table", "td", "th", "caption", "object", "template"})
TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attributes>(?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*+)>|<[!?/][^>]*+(?:>|\Z)|<[a-zA-Z][^>]*+\Z""",
    re.S,
)
ATTRIBUTE = re.compile(r"""(?<![^\s=/"'>])([^\s=/"'>]++)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"']++))""")
NAME_PART = re.compile(r"[^\W\d_]+")
WORD = re.compile(r"\w+")

PATH, WORDS, NUMBERS, HIDDEN = 384, 32, 9, 32
INPUT = PATH + WORDS + NUMBERS
#: Times that a place of a path vector counts at most, and open elements that its depth counts.
MOST, DEEPEST = 2, 20


def _spot(token: str, size: int) -> int:
    """A hashed place below 2 * size; those from size on count as -1 at place - size."""
    return zlib.crc32(token.encode("utf-8", "surrogatepass")) % (2 * size)


_words = Memo(lambda word: _spot(word, WORDS))


class Element(NamedTuple):
    tag: str
    places: tuple[tuple[int, int], ...]  # of its tokens in a path vector, and their signs
    names: tuple[str, ...]  # parts of its class, id and role
    mark: str  # of generated pages


def _element(tag: str, attributes: str) -> Element:
    return _read_element(tag, attributes) if len(tag) + len(attributes) <= 1000 else _read_element.__wrapped__(tag, attributes)


@lru_cache(20_000)
def _read_element(tag: str, attributes: str) -> Element:
    found = {key.lower(): a or b or c for key, a, b, c in reversed(ATTRIBUTE.findall(attributes))} if attributes else {}
    names = tuple("c:" + part.lower() for key in ("class", "id", "role") for part in NAME_PART.findall(found.get(key, "")))
    spots = [_spot(token, PATH) for token in ("t:" + tag, *names)]
    return Element(tag, tuple((s % PATH, 1 if s < PATH else -1) for s in spots), names, found.get("data-main", ""))


class Open:
    """The open elements at a place of a page, and what they add up to.

    Every element is pushed and popped once, and each takes a few steps, however many are open."""

    def __init__(self):
        self.elements: list[Element] = []
        self.at: dict[str, list[int]] = {}  # places of open elements by tag, innermost last
        self.sums, self.clipped = [0] * PATH, bytearray([MOST]) * PATH
        self.named: list[tuple[str, ...]] = [()]
        self.sections, self.marks = [""], [""]

    def _add(self, element: Element, by: int) -> None:
        for place, sign in element.places:
            self.sums[place] += by * sign
            self.clipped[place] = MOST + max(-MOST, min(MOST, self.sums[place]))

    def push(self, tag: str, attributes: str) -> None:
        element = _element(tag, attributes)
        self.at.setdefault(tag, []).append(len(self.elements))
        self.elements.append(element)
        self._add(element, 1)
        if element.names:
            self.named.append(element.names)
        if tag in SECTIONS:
            self.sections.append(tag)
        if element.mark:
            self.marks.append(element.mark)

    def pop(self) -> None:
        element = self.elements.pop()
        self.at[element.tag].pop()
        self._add(element, -1)
        if element.names:
            self.named.pop()
        if element.tag in SECTIONS:
            self.sections.pop()
        if element.mark:
            self.marks.pop()

    def innermost(self, tags) -> int:
        return max((places[-1] for tag in tags if (places := self.at.get(tag))), default=-1)

    def close(self, tags, within=()) -> None:
        """Close the innermost of tags and all in it, unless one of `within` is open further in."""
        place = self.innermost(tags)
        if place >= 0 and place > self.innermost(within):
            while len(self.elements) > place:
                self.pop()

    def path(self) -> tuple:
        """What block vectors say of the open elements; text outside of all counts as in the body."""
        if not self.elements:
            self.push("body", "")
            try:
                return self.path()
            finally:
                self.pop()
        tag, deep = self.elements[-1].tag, min(len(self.elements), DEEPEST)
        return bytes(self.clipped), tag, self.named[-1], self.sections[-1], deep, self.marks[-1]


class Page(NamedTuple):
    texts: list[str]
    linked: array  # characters in links
    path: array  # which of the paths
    paths: list[tuple]


def blocks(page: str) -> Page:
    """The blocks of a page in order, with character references decoded and white space collapsed.

    References are decoded in each run of text between tags, never over a tag. Unclosed elements
    are closed as browsers do for paragraphs, items and cells; end tags without a start are
    passed over; a tag or comment that the end of the page cuts is no text.
    """
    out = Page([], array("q"), array("q"), [])
    numbers: dict[tuple, int] = {}
    open_ = Open()
    parts: list[str] = []
    links, path = 0, -1

    def add(raw: str) -> None:
        nonlocal links, path
        if not raw:
            return
        text = unescape(raw) if "&" in raw else raw
        if path < 0 and not text.isspace():
            key = open_.path()
            path = numbers.setdefault(key, len(numbers))
            if path == len(out.paths):
                out.paths.append(key)
        if open_.at.get("a"):
            links += len(text.strip())
        parts.append(text)

    def flush() -> None:
        nonlocal links, path
        if path >= 0 and (text := " ".join("".join(parts).split())):
            out.texts.append(text)
            out.linked.append(links)
            out.path.append(path)
        parts.clear()
        links, path = 0, -1

    at = 0
    while at < len(page):
        found = TOKEN.search(page, at)
        if found is None:
            add(page[at:])
            break
        add(page[at : found.start()])
        at = found.end()
        if found["name"] is None:
            continue
        name = found["name"].lower()
        if name == "br":
            add(" ")
            continue
        if name in BLOCKS:
            flush()
        if found["end"]:
            open_.close((name,))
            continue
        if name in CLOSES:
            open_.close(*CLOSES[name])
        elif name in BLOCKS:
            open_.close(("p",), IN_P)
        if name in VOID:
            continue
        open_.push(name, found["attributes"])
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
            stop = end.start() if end else len(page)
            if name not in UNSEEN:
                add(page[at:stop])
                flush()
            open_.close((name,))
            tail = page.find(">", stop)
            at = len(page) if tail < 0 else tail + 1
    flush()
    return out


def path_vectors(paths: list[tuple]) -> np.ndarray:
    out = np.empty((len(paths), PATH), np.float32)
    for k, (clipped, tag, names, section, _, _) in enumerate(paths):
        row = np.frombuffer(clipped, np.uint8).astype(np.float32) - MOST
        # what lies innermost decides most often, so it also has places of its own
        for token in ("l:" + tag, "s:" + section, *("n:" + name for name in names)):
            spot = _spot(token, PATH)
            row[spot % PATH] += 1 if spot < PATH else -1
        out[k] = np.clip(row, -MOST, MOST)
    return out


def text_vectors(page: Page, at_once: int = 4096) -> np.ndarray:
    """Hashed words of each block and its numbers."""
    total = len(page.texts)
    out = np.empty((total, WORDS + NUMBERS), np.float32)
    deep = np.array([path[4] for path in page.paths], np.float32)
    for lo in range(0, total, at_once):
        texts = page.texts[lo : lo + at_once]
        n = len(texts)
        words = [WORD.findall(text.lower()) for text in texts]
        count = np.fromiter(map(len, words), np.int64, n)
        spots = np.fromiter(map(_words.__getitem__, chain.from_iterable(words)), np.int64, int(count.sum()))
        seen = np.bincount(np.repeat(np.arange(n) * 2 * WORDS, count) + spots, minlength=n * 2 * WORDS).reshape(n, 2, WORDS)
        size = np.fromiter(map(len, texts), np.float64, n)
        stops = np.array([sum(map(text.count, ".,;:!?")) for text in texts])
        here = slice(lo, lo + n)
        out[here, :WORDS] = (seen[:, 0] - seen[:, 1]) / (2 * np.sqrt(np.maximum(count, 1)))[:, None]
        out[here, WORDS:] = np.stack(
            [
                np.log1p(size) / 6, np.log1p(count) / 5, np.minimum(np.array(page.linked[here]) / size, 1), np.minimum(stops / np.maximum(count, 1), 1),
                [text[-1] in ".!?" for text in texts], np.arange(lo, lo + n) / total, deep[np.array(page.path[here])] / 10,
                [text[0].isupper() for text in texts], np.full(n, 1 / total),
            ],
            1,
        )
    return out


def vectors(page: Page) -> np.ndarray:
    """The vectors of all blocks of a page, as the labeller is trained on."""
    return np.concatenate([path_vectors(page.paths)[np.array(page.path, np.int64)], text_vectors(page)], 1)


def is_marked(page: Page) -> np.ndarray:
    """Which blocks a generated page marks as main text: the innermost mark counts."""
    return np.array([page.paths[k][5] == "1" for k in page.path], np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


#: Blocks times pages that are labelled at once.
AT_ONCE = 4096


class Labeller:
    """Bidirectional LSTM over block vectors with one logistic output for each block."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.p: dict[str, np.ndarray] = {"out": rng.normal(0, 0.2, (2 * HIDDEN, 1)), "out_b": np.zeros(1)}
        for side in "fb":
            self.p["x" + side] = rng.normal(0, 1 / np.sqrt(INPUT), (INPUT, 4 * HIDDEN))
            self.p["h" + side] = rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 4 * HIDDEN))
            self.p["b" + side] = np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)  # in, forget, out, candidate
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _run(self, pre: np.ndarray, live: np.ndarray, side: str, state: tuple | None = None, keep: list | None = None) -> tuple[np.ndarray, tuple]:
        """Hidden states (time, page, HIDDEN) from projected inputs, and the state that is left; padding
        passes the state on."""
        steps, pages, _ = pre.shape
        h, c = state or (np.zeros((pages, HIDDEN), np.float32),) * 2
        out = np.empty((steps, pages, HIDDEN), np.float32)
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            z = pre[t] + h @ self.p["h" + side]
            gates, new = _sigmoid(z[:, : 3 * HIDDEN]), np.tanh(z[:, 3 * HIDDEN :])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            on = live[t][:, None]
            cell = np.where(on, f * c + i * new, c)
            squashed = np.tanh(cell)
            next_h = np.where(on, o * squashed, h)
            if keep is not None:
                keep.append((t, i, f, o, new, c, h, squashed, on))
            h, c = next_h, cell
            out[t] = h
        return out, (h, c)

    def score(self, pages: list[Page]) -> list[np.ndarray]:
        """Probability that a block is main text, for each block of each page. Several pages must hold
        AT_ONCE blocks at most, with padding; a page by itself can be of any length."""
        sizes = np.array([len(page.texts) for page in pages])
        steps, first = int(sizes.max(initial=0)), np.cumsum([0, *(len(page.paths) for page in pages)])
        time = np.concatenate([np.arange(n) for n in sizes])
        column = np.repeat(np.arange(len(pages)), sizes)
        known = path_vectors([path for page in pages for path in page.paths])
        at = np.concatenate([np.array(page.path, np.int64) + k for page, k in zip(pages, first)])
        rest = np.concatenate([text_vectors(page) for page in pages])
        raw = np.zeros((steps, len(pages)), np.float32)
        for n, side in enumerate("fb"):
            projected, of_rest = known @ self.p["x" + side][:PATH] + self.p["b" + side], self.p["x" + side][PATH:]
            state, starts = None, range(0, steps, AT_ONCE)
            for lo in starts if side == "f" else reversed(starts):
                own = slice(lo, lo + AT_ONCE) if len(pages) == 1 else slice(None)
                length = min(AT_ONCE, steps - lo)
                pre, live = np.zeros((length, len(pages), 4 * HIDDEN), np.float32), np.zeros((length, len(pages)), bool)
                pre[time[own] - lo, column[own]] = projected[at[own]] + rest[own] @ of_rest
                live[time[own] - lo, column[own]] = True
                states, state = self._run(pre, live, side, state)
                raw[lo : lo + length] += (states @ self.p["out"][n * HIDDEN : (n + 1) * HIDDEN])[..., 0]
        score = _sigmoid(raw + self.p["out_b"])
        return [score[:n, k] for k, n in enumerate(sizes)]

    def gradients(self, x: np.ndarray, live: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss and its slopes; x is (time, page, INPUT)."""
        kept: dict[str, list] = {"f": [], "b": []}
        both = np.concatenate([self._run(x @ self.p["x" + side] + self.p["b" + side], live, side, None, kept[side])[0] for side in "fb"], 2)
        p = _sigmoid(both @ self.p["out"] + self.p["out_b"])[..., 0]
        slope = np.where(live, p - y, 0) / live.sum()
        loss = -np.log(np.clip(np.where(y > 0, p, 1 - p), 1e-7, 1))[live].mean()
        g = {"out": both.reshape(-1, 2 * HIDDEN).T @ slope.reshape(-1, 1), "out_b": slope.sum(keepdims=True)[0]}
        into = slope[..., None] * self.p["out"][:, 0]
        for n, side in enumerate("fb"):
            dz = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
            dh = dc = np.zeros((x.shape[1], HIDDEN), np.float32)
            g["h" + side] = np.zeros_like(self.p["h" + side])
            for t, i, f, o, new, c, h, squashed, on in reversed(kept[side]):
                dh = dh + into[t][:, n * HIDDEN : (n + 1) * HIDDEN]
                cell = dc + dh * o * (1 - squashed**2)
                step = np.concatenate([cell * new * i * (1 - i), cell * c * f * (1 - f), dh * squashed * o * (1 - o), cell * i * (1 - new**2)], 1)
                step = np.where(on, step, 0)
                dz[t] = step
                g["h" + side] += h.T @ step
                dh = np.where(on, step @ self.p["h" + side].T, dh)
                dc = np.where(on, cell * f, dc)
            g["x" + side] = x.reshape(-1, INPUT).T @ dz.reshape(-1, 4 * HIDDEN)
            g["b" + side] = dz.sum((0, 1))
        return float(loss), g


#: The weights, written by train_labeller.py.
WEIGHTS = Path(__file__).with_name("labeller.npz")


@lru_cache(1)
def labeller() -> Labeller:
    net = Labeller()
    with np.load(WEIGHTS) as kept:
        net.p = {name: kept[name].astype(np.float32) for name in net.p}
    return net


def main_texts(pages: list[str | None], net: Labeller) -> list[str]:
    """Main text of each page: its main blocks in order with an empty line between them."""
    cut = [blocks(page or "") for page in pages]
    out = [""] * len(pages)
    order = sorted((k for k in range(len(cut)) if cut[k].texts), key=lambda k: len(cut[k].texts))
    at = 0
    while at < len(order):
        stop = at + 1
        while stop < len(order) and (stop + 1 - at) * len(cut[order[stop]].texts) <= AT_ONCE:
            stop += 1
        group = order[at:stop]
        for k, score in zip(group, net.score([cut[k] for k in group])):
            out[k] = "\n\n".join(text for text, s in zip(cut[k].texts, score.tolist()) if s >= 0.5)
        at = stop
    return out


def _extract(shared, at_once: int = 500):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                for lo in range(0, part.num_rows, at_once):
                    some = part.slice(lo, at_once)
                    text = main_texts(some.column(1).to_pylist(), shared.value)
                    values = [pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())]
                    yield pa.RecordBatch.from_arrays([some.column(0), some.column(2), *values], ["id", "url", "text", "n_chars"])

    return run


def extract_main_text(df: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """The id and url columns, text (empty if there is none) and n_chars (code points) of each page.

    A null page counts as empty. Elements can be nested to any depth: all open ones count for a
    block, each place of its path vector up to MOST times. Repeated rows give a row each, an empty
    table none; other columns are not read.
    """
    spark = df.sparkSession
    ship(spark)
    kind, url = (df.schema[c].dataType.simpleString() for c in (id_col, url_col))
    shared = spark.sparkContext.broadcast(labeller())
    narrow = df.select(F.col(id_col).alias("id"), F.col(html_col).cast("string").alias("html"), F.col(url_col).alias("url"))
    out = spread(narrow).mapInArrow(_extract(shared), f"id {kind}, url {url}, text string, n_chars long")
    return out.withColumnsRenamed({"id": id_col, "url": url_col})
