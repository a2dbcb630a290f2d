"""Byte-level BPE ids, equal to those of the tokenizers library for the same vocabulary.

The vocabulary is read in its rank form and encoded by tiktoken, which takes about an eighth of
the time; the special token's text is the special token, as it is for the other library. tiktoken's
pattern engine fails on runs of about a million white-space characters, so long runs are cut off here.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa


VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value of the vocabulary: its special token.
SPECIAL = {"<|endoftext|>": 50256}
#: White-space characters from which a run is cut off, and such a run (the pattern's \s, which has no U+001C to U+001F).
RUN, SPACE = 100_000, r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
SPACES = re.compile(rf"(?<!{SPACE}){SPACE}{{{RUN},}}")


@lru_cache(2)
def encoding(path: str = public_tokenizers.path(VOCABULARY)):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)


def _ids(text: str, path: str) -> list[int]:
    """The pattern makes one piece of a run of white space at a text's end or before a special token, and
    else of all of the run but its last character: that piece is merged alone, without the pattern."""
    whole = encoding(path)
    ids, at = [], 0
    for run in SPACES.finditer(text) if len(text) >= RUN else ():
        end = run.end()
        if end < len(text) and not text.startswith(tuple(SPECIAL), end):
            end -= 1
        ids += whole.encode(text[at : run.start()], allowed_special="all")
        ids += whole._encode_single_piece(text[run.start() : end].encode())
        at = end
    return ids + whole.encode(text[at:], allowed_special="all")


def encode(text: str | None, path: str = public_tokenizers.path(VOCABULARY), end: int | None = None) -> np.ndarray:
    """uint16 ids of a text (null: none), with the id `end` after them if one is given."""
    ids = _ids(text, path) if text else []
    if end is not None:
        ids.append(end)
    return np.array(ids, np.uint16)


def encode_column(texts: pa.Array, path: str = public_tokenizers.path(VOCABULARY), end: int | None = None):
    for value in texts:
        yield encode(value.as_py(), path, end)
