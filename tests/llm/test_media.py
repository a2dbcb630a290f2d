import hashlib
import os
import struct
import zlib
from collections import Counter

import numpy as np
import pytest

from quern.llm.media import FRAME, _box, _full, media_columns, read_media, sample_bytes, text_media, wrap
from quern.llm.queries import op1_media_columns, oracle_sql


def payload(text):
    raw = (text or "").encode()
    return raw + b"\xff" * (max(1, -(-len(raw) // FRAME)) * FRAME - len(raw))


@pytest.mark.parametrize("n", [0, 1, 575, 576, 577, 576 * 40, 100_001])
def test_round_trip(n):
    raw = bytes(np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8))
    data = wrap(raw)
    track = read_media(data)["tracks"][0]
    stored = sample_bytes(data, track)
    assert stored[:n] == raw and set(stored[n:]) <= {255} and len(stored) % FRAME == 0 and len(stored) > 0
    assert track["codec"] == "raw " and track["duration"] == len(stored) / 8000
    start, size = track["keyframes"][-1]
    assert data[start : start + size] in stored and len(track["keyframes"]) == len(stored) // FRAME


def test_interleaved_chunks_and_variable_sizes():
    sizes, frames = [3, 5, 2, 7, 1], [b"aaa", b"bbbbb", b"cc", b"ddddddd", b"e"]
    head = _box(b"ftyp", b"isom")
    body = b"XX" + b"".join(frames[:2]) + b"YYYY" + b"".join(frames[2:4]) + b"Z" + frames[4]
    at = len(head) + 8
    chunks = [at + 2, at + 2 + 8 + 4, at + 2 + 8 + 4 + 9 + 1]
    tables = _box(
        b"stbl",
        _full(b"stsd", struct.pack(">I", 1), _box(b"avc1", bytes(78))),
        _full(b"stts", struct.pack(">IIIII", 2, 4, 10, 1, 20)),
        _full(b"stss", struct.pack(">III", 2, 1, 4)),
        _full(b"stsc", struct.pack(">IIIIIII", 2, 1, 2, 1, 3, 1, 1)),
        _full(b"stsz", struct.pack(">II5I", 0, 5, *sizes)),
        _full(b"co64", struct.pack(">I3Q", 3, *chunks)),
    )
    track = _box(b"trak", _box(b"mdia", _full(b"mdhd", struct.pack(">IIIII", 0, 0, 30, 60, 0)), _box(b"minf", tables)))
    data = head + _box(b"mdat", body) + _box(b"moov", track, _box(b"free", b"??"))
    got = read_media(data)["tracks"][0]
    assert got["codec"] == "avc1" and got["duration"] == 2.0
    assert [data[a : a + n] for a, n in zip(got["offset"], got["size"])] == frames
    assert [data[a : a + n] for a, n in got["keyframes"]] == [frames[0], frames[3]]
    assert sample_bytes(data, got) == b"".join(frames)


@pytest.mark.parametrize("data", [b"", b"\0", b"not a media file at all", wrap(b"abc")[:700], b"\0\0\0\x01mdat" + b"\xff" * 8])
def test_broken_files(data):
    for track in read_media(data)["tracks"]:
        assert len(track["offset"]) == len(track["size"])


def test_random_damage():
    data, rng = wrap(b"some payload" * 100), np.random.default_rng(0)
    for _ in range(300):
        bad = bytearray(data)
        for k in rng.integers(0, len(bad), 5):
            bad[k] = rng.integers(0, 256)
        for track in read_media(bytes(bad))["tracks"]:
            sample_bytes(bytes(bad), track)


def test_text_media(edge, edge_rows, nothing):
    got = sorted(text_media(edge).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.n_bytes))
    want = sorted(edge_rows, key=lambda r: (r[0] is None, r[0] or 0, len((r[1] or "").encode())))
    assert len(got) == len(want)
    for r, (doc, text, *_) in zip(got, want):
        whole = payload(text)
        assert (r.doc_id, r.n_bytes, r.payload_bytes) == (doc, len((text or "").encode()), len(whole))
        assert r.payload_sha256 == hashlib.sha256(whole).hexdigest() and r.tail_crc32 == zlib.crc32(whole[-32:])
        (track,), media = r.tracks, wrap((text or "").encode())
        assert r.media_bytes == len(media) and track.codec == "raw " and track.n_frames == len(whole) // FRAME
        assert b"".join(media[k.offset : k.offset + k.length] for k in track.keyframes) == whole  # every sample is a keyframe
    assert text_media(nothing).count() == 0


def test_media_columns_of_other_bytes(spark):
    df = spark.createDataFrame([(1, wrap(b"x")), (2, None), (3, b""), (4, b"junk" * 50)], "doc_id bigint, media binary")
    got = {r.doc_id: [(t.codec, t.duration, t.n_frames, len(t.keyframes)) for t in r.tracks] for r in media_columns(df).collect()}
    assert got == {1: [("raw ", FRAME / 8000, 1, 1)], 2: [], 3: [], 4: []}


def test_all_tracks_are_described(spark):
    """Sound first, then pictures, which alone have a table of sync samples."""

    def track(codec, sizes, chunk, scale, step, keys=()):
        tables = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), _box(codec, bytes(20))),
            _full(b"stts", struct.pack(">III", 1, len(sizes), step)),
            _full(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)) if keys else b"",
            _full(b"stsc", struct.pack(">IIII", 1, 1, len(sizes), 1)),
            _full(b"stsz", struct.pack(f">II{len(sizes)}I", 0, len(sizes), *sizes)),
            _full(b"stco", struct.pack(">II", 1, chunk)),
        )
        return _box(b"trak", _box(b"mdia", _full(b"mdhd", struct.pack(">IIIII", 0, 0, scale, 0, 0)), _box(b"minf", tables)))

    head = _box(b"ftyp", b"isom")
    at = len(head) + 8
    data = head + _box(b"mdat", b"aabbb" + b"PIC1p2p3PIC4") + _box(b"moov", track(b"mp4a", [2, 3], at, 100, 50), track(b"avc1", [4, 2, 2, 4], at + 5, 30, 15, (1, 4)))
    row = media_columns(spark.createDataFrame([(1, data)], "doc_id bigint, media binary"), payload=True).first()
    sound, pictures = row.tracks
    assert (sound.codec, sound.duration, sound.n_frames) == ("mp4a", 1.0, 2) and (pictures.codec, pictures.duration, pictures.n_frames) == ("avc1", 2.0, 4)
    cut = [[data[k.offset : k.offset + k.length] for k in t.keyframes] for t in row.tracks]
    assert cut == [[b"aa", b"bbb"], [b"PIC1", b"PIC4"]]
    assert row.payload_bytes == 17 and row.payload_sha256 == hashlib.sha256(b"aabbbPIC1p2p3PIC4").hexdigest()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
def test_query_equals_sql(spark, edge, tmp_path):
    import duckdb

    edge.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    for folder, files in ((str(tmp_path), f"{tmp_path}/documents.parquet/*.parquet"), ("/root/testdata/sf0.001", "/root/testdata/sf0.001/documents.parquet")):
        got = op1_media_columns(spark, folder)
        with duckdb.connect() as base:
            base.sql(f"CREATE VIEW documents AS SELECT * FROM '{files}'")
            want = base.sql(oracle_sql()["op1_media_columns"])
            assert sorted(want.columns) == sorted(got.columns)
            assert Counter(want.project(", ".join(got.columns)).fetchall()) == Counter(map(tuple, got.collect()))
