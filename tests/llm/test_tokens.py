"""Packing, token counts, SentencePiece and id files against the libraries."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from urllib.parse import unquote, urlparse

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest

from quern.llm import repair
from quern.llm.bytebpe import encode
from quern.llm.packing import pack_documents, place_lengths, slots
from quern.llm.repair import GROUP_BYTES, LEAST, TERMINALS, Block, compress, read_ids, write_ids
from quern.llm.spm import BYTE, MODEL, NORMAL, model, read_model, sentencepiece_digests, sentencepiece_ids
from quern.llm.token_count import UnigramCounter, counter, token_counts

PARTS = [" ", " ", "  ", "     ", "\n", "\r\n", "\t", "a", "the", "The", "in", "er", "1", "23", ".", "!!", "é", "ß", " ", "　", "😀", "▁", "▁▁", '"', "don't", "\x00", "​", "ñó", "ing", "tion", "日本", "ﬁ", "ท", "�", "zq", "<|endoftext|>", "<s>", "\x1c", "\x85", " " * 17]


def texts(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) for _ in range(r.randint(0, 18))) for _ in range(n)]


def byte_bpe():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_byte_bpe_equals_tokenizers():
    library = byte_bpe()
    for text in texts(4000, 1):
        assert encode(text).tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_byte_bpe_of_long_white_space_equals_tokenizers():
    library = byte_bpe()
    for run in (" " * 1_100_000, "\n" * 1_100_000, "\u3000" * 1_100_000, " \t\r\n" * 300_000, "\x85\xa0" * 60_000 + "\u2003" * 10):
        for text in (run, "a" + run, "a" + run + "b", run + ".5", "a" + run + "<|endoftext|>b" + run[:200_000] + " x"):
            assert encode(text).tolist() == library.encode(text, add_special_tokens=False).ids, repr(text[-20:])
    for n in (99_999, 100_000, 100_001):
        for text in ("a" + " " * n + "b", "\x1c" + " " * n + "\x1c" + " " * n + "\u200b"):
            assert encode(text).tolist() == library.encode(text, add_special_tokens=False).ids, n


def test_sentencepiece_equals_library():
    import sentencepiece

    library, own = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(MODEL)), model()
    for text in texts(8000, 2):
        ids = library.encode(text)
        assert own.encode(text) == ids, repr(text)
        assert own.decode(ids) == library.decode(ids), repr(text)
        want = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
        assert own.digest(text) == want, repr(text)
    r = random.Random(4)
    for _ in range(4000):  # ids that no text gives
        ids = [r.choice([0, 1, 2, r.randint(3, 258), r.randint(259, 31999), 28705, 260]) for _ in range(r.randint(0, 9))]
        assert own.decode(ids) == library.decode(ids), ids


def test_runs_of_spaces_equal_library():
    import sentencepiece

    library, own = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(MODEL)), model()
    for n in range(1, 140):
        for text in (" " * n, "a" + " " * n + "b", " " * n + "é"):
            assert own.encode(text) == library.encode(text), repr(text)


def test_long_texts_without_words_take_linear_time():
    for text in (" " * 200_000, "x" * 200_000, "日本" * 50_000, "\n" * 100_000):
        model().digest(text)
        counter().count(text)
        encode(text)
    assert all(len(word) <= 64 for word in model().word)


def test_pair_test_equals_merging():
    own, r = model(), random.Random(5)
    pieces = list(own.spines)
    for _ in range(5000):
        a, b = r.choice(pieces[:6000]), r.choice(pieces[:6000])
        assert own._apart(own.id[a] * len(own.pieces) + own.id[b]) == (own.merge(a + b) == [a, b]), (a, b)


def unigram(vocabulary, fallback):
    from tokenizers import Tokenizer, models, pre_tokenizers

    made = Tokenizer(models.Unigram(vocabulary, 0, fallback))
    made.pre_tokenizer = pre_tokenizers.Metaspace("▁", "always", True)
    return made


def test_token_counts_equal_library():
    pieces = read_model(public_tokenizers.path(MODEL))[0]
    worst = [(text, -1e9) for text, _, kind in pieces if kind == BYTE]
    library = unigram([("<unk>", -1e9)] + [(t, s) for t, s, kind in pieces if kind == NORMAL] + worst, True)
    for text in texts(4000, 6):
        assert counter().count(text)[0] == len(library.encode(text).ids), repr(text)


@pytest.mark.parametrize("fallback", [True, False])
def test_token_counts_with_ties_and_few_pieces(fallback):
    r = random.Random(7)
    vocabulary = [(t, float(-r.randint(1, 4))) for t in {"".join(r.choice("ab▁é") for _ in range(r.randint(1, 4))) for _ in range(60)}]
    own = UnigramCounter(vocabulary, fallback)
    own.unknown = -30.0
    # the library has byte pieces too, at the worst score
    library = unigram([("<unk>", -20.0)] + vocabulary + [(f"<0x{k:02X}>", -20.0) for k in range(256)], fallback)
    for _ in range(3000):
        text = "".join(r.choice("aabb é日x") for _ in range(r.randint(0, 12)))
        assert own.count(text)[0] == len(library.encode(text).ids), repr(text)


def test_digests_and_counts_of_edge_rows(edge, edge_rows, nothing):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(MODEL))
    want = Counter((doc, ",".join(map(str, library.encode(text or "")))) for doc, text, *_ in edge_rows)
    assert Counter((r.doc_id, ",".join(map(str, r.ids))) for r in sentencepiece_ids(edge).collect()) == want
    digests = Counter((doc, ids.count(",") + bool(ids), hashlib.sha256(ids.encode()).hexdigest()) for doc, ids in want.elements())
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in sentencepiece_digests(edge).collect()) == digests
    assert Counter((r.doc_id, r.n_tokens) for r in token_counts(edge).collect()) == Counter((r[0], counter().count(r[1])[0]) for r in edge_rows)
    for made in (sentencepiece_ids, sentencepiece_digests, token_counts):
        assert made(nothing).count() == 0


def test_id_files(edge, edge_rows, nothing):
    library = byte_bpe()
    rows = sorted(edge_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    ids = [np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4") for _, t, *_ in rows]
    starts = np.cumsum([0, *map(len, ids)])
    want = [(r[0], int(s), len(x), zlib.crc32(x.tobytes())) for r, s, x in zip(rows, starts, ids)]
    got = read_ids(write_ids(edge, block=500)).orderBy("start").collect()
    assert [tuple(r) for r in got] == want
    assert read_ids(write_ids(nothing)).count() == 0


def test_block_files_hold_few_blocks_in_a_row_group(spark):
    r = random.Random(13)
    rows = [(7, "")] + [(7, "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=800_000))) for _ in range(14)]  # one id: one file
    files = write_ids(spark.createDataFrame(rows, "doc_id long, text string"), block=100_000)
    groups = [(g.total_byte_size, g.num_rows) for p in files.inputFiles() for m in [pq.read_metadata(unquote(urlparse(p).path))] for g in map(m.row_group, range(m.num_row_groups))]
    assert sum(n for _, n in groups) == len(rows) and sum(size for size, _ in groups) > 2 * GROUP_BYTES
    assert max(size for size, _ in groups) < 1.5 * GROUP_BYTES
    got = sorted((x.start, x.n_tokens, x.ids_crc32) for x in read_ids(files).collect())
    ids = [np.append(encode(text), 2).astype("<u4") for _, text in sorted(rows)]
    assert got == [(int(at), len(x), zlib.crc32(x.tobytes())) for at, x in zip(np.cumsum([0, *map(len, ids)]), ids)]


def test_few_texts_are_decoded_at_once_while_ids_are_written(spark, edge, monkeypatch):
    name, seen = "spark.sql.parquet.columnarReaderBatchSize", []
    monkeypatch.setattr(repair, "stored", lambda df, *_, **__: seen.append(spark.conf.get(name)))
    write_ids(edge)
    assert seen == ["128"] and spark.conf.get(name) == "4096"
    spark.conf.set(name, "1000")  # a setting of the session's own stays
    try:
        write_ids(edge)
        assert seen[1:] == ["1000"] and spark.conf.get(name) == "1000"
    finally:
        spark.conf.unset(name)


def test_grammar_round_trip():
    rng = np.random.default_rng(8)
    for alphabet in (1, 2, 5, TERMINALS):
        docs = [rng.integers(0, alphabet, n).astype(np.uint16) for n in (0, 1, 2, 3, 0, 1000, 5000, 1)] * 3
        block = Block(compress(np.concatenate(docs), np.array([len(d) for d in docs])))
        assert np.array_equal(block.all_ids(), np.concatenate(docs))
        for k, d in enumerate(docs):
            assert np.array_equal(block.document(k), d) and np.array_equal(block.document(k, 7, 400), d[7:400])
    repeated = np.tile(np.arange(50, dtype=np.uint16), 400)
    assert len(compress(repeated, np.array([len(repeated)]))) < len(repeated) / 4
    with pytest.raises(ValueError):
        Block(b"\0" * 64)


def test_place_lengths():
    r = random.Random(9)
    for case in ({1: 5000}, {1024: 3}, {513: 10}, {600: 4, 424: 4}, {}, {r.randint(1, 1024): r.randint(1, 400) for _ in range(200)}):
        patterns = place_lengths(case)
        seen = Counter()
        for pattern, n in patterns:
            assert sum(pattern) <= 1024 and n > 0
            for length in pattern:
                seen[length] += n
        assert seen == Counter(case)
        packs, ids = sum(n for _, n in patterns), sum(k * n for k, n in case.items())
        if len(case) > 50:
            assert packs * 1024 < ids * 1.03
        places = set()
        for length, rows in slots(patterns).items():
            for k in range(case[length]):
                at = rows[np.searchsorted(rows[:, 0], k, "right") - 1]
                places.add((int(at[1] + k - at[0]), int(at[2])))
        assert len(places) == sum(case.values())


def one_by_one(histogram, size):
    """How full packs get when each piece, longest first, goes to the shortest pack that takes it."""
    packs = []
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            least = min(range(len(packs)), key=packs.__getitem__, default=None)
            if least is not None and packs[least] + length <= size:
                packs[least] += length
            else:
                packs.append(length)
    return Counter(packs)


def test_places_are_those_of_shortest_pack_first():
    r = random.Random(12)
    cases = [({6: 1, 2: 2}, 10)] + [({r.randint(1, 40): r.randint(1, 9) for _ in range(r.randint(1, 15))}, 40) for _ in range(200)]
    for histogram, size in cases:
        got = Counter()
        for pattern, n in place_lengths(histogram, size):
            got[sum(pattern)] += n
        assert got == one_by_one(histogram, size), histogram


def test_pack_documents(edge, edge_rows, nothing):
    library = byte_bpe()
    want = Counter()
    for doc, text, *_ in edge_rows:
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        for at in range(0, len(ids), 1024):
            want[doc, at, zlib.crc32(ids[at : at + 1024].tobytes()), len(ids[at : at + 1024]), len(ids)] += 1
    got = pack_documents(edge, with_ids=True).collect()
    assert Counter((r.doc_id, r.start, r.ids_crc32, r.length, r.doc_tokens) for r in got) == want
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in got)
    packs = defaultdict(list)
    for r in got:
        packs[r.sequence_id].append((r.offset, r.length))
    for pieces in packs.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 1024
    assert pack_documents(nothing).count() == 0


def test_pairs_are_replaced_until_none_is_frequent():
    ids = np.tile(np.random.default_rng(2).integers(0, TERMINALS, 1000).astype(np.uint16), 200)
    block = Block(compress(ids, np.array([len(ids)])))
    assert np.array_equal(block.all_ids(), ids) and block.widths.max() > 64 and len(block.symbols) < len(ids) // 64
    symbols = block.symbols.tolist()
    assert max(Counter(zip(symbols, symbols[1:])).values()) < LEAST
