"""Media columns over ISO base media files.

`wrap` stores a payload losslessly as one track of 8-bit samples; `read_media` walks the nested
boxes of any such file, decodes the sample tables and returns codec, duration and the byte ranges
of the keyframes. Reading never decodes a payload: it only follows offsets and sizes.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import byte_rows, ship, slices, spread, stored

#: Fixed values of the container format: boxes that hold boxes.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex"}
MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
FRAME, RATE, FILL = 576, 8000, b"\xff"


def _box(kind: bytes, *parts: bytes) -> bytes:
    size = 8 + sum(map(len, parts))
    if size < 1 << 32:
        return b"".join((struct.pack(">I", size), kind, *parts))
    return b"".join((struct.pack(">I", 1), kind, struct.pack(">Q", size + 8), *parts))


def _full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", flags), *parts)


def wrap(raw: bytes, frame: int = FRAME, rate: int = RATE) -> bytes:
    """An ISO media file whose only track holds raw, filled up with bytes 255 to whole frames.

    Each sample can be decoded alone, so there is no table of sync samples: all are keyframes."""
    frames = max(1, -(-len(raw) // frame))
    payload = raw + FILL * (frames * frame - len(raw))
    ticks = len(payload)
    kind = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"mp41")
    long = len(payload) + 16 >= 1 << 32
    start = len(kind) + (16 if long else 8)
    entry = _box(b"raw ", bytes(6), struct.pack(">H8xHHHHI", 1, 1, 8, 0, 0, rate << 16))
    place = _full(b"co64", struct.pack(">IQ", 1, start)) if long else _full(b"stco", struct.pack(">II", 1, start))
    tables = _box(
        b"stbl",
        _full(b"stsd", struct.pack(">I", 1), entry),
        _full(b"stts", struct.pack(">III", 1, frames, frame)),
        _full(b"stsc", struct.pack(">IIII", 1, 1, frames, 1)),
        _full(b"stsz", struct.pack(">II", frame, frames)),
        place,
    )
    source = _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1)))
    media = _box(
        b"mdia",
        _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, rate, ticks & 0xFFFFFFFF, 0x55C4, 0)),
        _full(b"hdlr", bytes(4), b"soun", bytes(12), b"\0"),
        _box(b"minf", _full(b"smhd", bytes(4)), source, tables),
    )
    head = _full(b"tkhd", struct.pack(">IIIII8xHHHH", 0, 0, 1, 0, ticks & 0xFFFFFFFF, 0, 0, 256, 0), MATRIX, bytes(8), flags=7)
    movie = _full(
        b"mvhd", struct.pack(">IIIIIH10x", 0, 0, rate, ticks & 0xFFFFFFFF, 0x10000, 256), MATRIX, bytes(24), struct.pack(">I", 2)
    )
    return b"".join((kind, _box(b"mdat", payload), _box(b"moov", movie, _box(b"trak", head, media))))


def walk(data: bytes, start: int = 0, end: int | None = None, path: tuple = ()) -> Iterator[tuple[tuple, int, int]]:
    """(path, start, end) of the body of each box, outer boxes before inner ones.

    A size of 1 has a 64-bit size after it, a size of 0 reaches to the end. A box that is
    cut short or longer than what holds it ends the walk of its parent.
    """
    end = len(data) if end is None else end
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1 and start + 16 <= end:
            size, body = struct.unpack_from(">Q", data, body)[0], start + 16
        elif size == 0:
            size = end - start
        if size < body - start or start + size > end:
            return
        yield (*path, kind), body, start + size
        if kind in CONTAINERS:
            yield from walk(data, body, start + size, (*path, kind))
        start += size


def _table(data: bytes, at: tuple[int, int] | None, wide: str = ">u4", width: int = 1) -> np.ndarray:
    """The entries of a full box that starts with their number; only whole entries count."""
    if at is None or at[1] - at[0] < 8:
        return np.empty((0, width), np.int64)
    n, step = struct.unpack_from(">I", data, at[0] + 4)[0], np.dtype(wide).itemsize * width
    n = min(n, (at[1] - at[0] - 8) // step)
    return np.frombuffer(data, wide, n * width, at[0] + 8).reshape(n, width).astype(np.int64)


def samples(data: bytes, boxes: dict[bytes, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Offset and size of each sample, from the chunk tables."""
    chunks = _table(data, boxes[b"co64"], ">u8") if b"co64" in boxes else _table(data, boxes.get(b"stco"))
    runs, chunks = _table(data, boxes.get(b"stsc"), width=3), chunks[:, 0]
    sizes = np.empty(0, np.int64)
    if b"stsz" in boxes and boxes[b"stsz"][1] - boxes[b"stsz"][0] >= 12:
        at = boxes[b"stsz"][0]
        one, n = struct.unpack_from(">II", data, at + 4)
        room = (len(data) // one) if one else (boxes[b"stsz"][1] - at - 12) // 4
        n = min(n, room)
        sizes = np.full(n, one, np.int64) if one else np.frombuffer(data, ">u4", n, at + 12).astype(np.int64)
    if not len(chunks) or not len(runs) or not len(sizes):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    run = np.searchsorted(runs[:, 0], np.arange(1, len(chunks) + 1), "right") - 1
    held = np.minimum(np.where(run >= 0, runs[run, 1], 0), len(sizes))
    chunk = np.repeat(np.arange(len(chunks)), held)[: len(sizes)]
    sizes = sizes[: len(chunk)]
    before = np.cumsum(sizes) - sizes
    first = np.concatenate(([True], chunk[1:] != chunk[:-1])) if len(chunk) else np.empty(0, bool)
    base = np.maximum.accumulate(np.where(first, before, 0)) if len(chunk) else before
    return chunks[chunk] + before - base, sizes


def read_media(data: bytes) -> dict:
    """Tracks of a file: codec, duration in seconds, samples (offset, size), keyframe byte ranges."""
    tracks: list[dict] = []
    for path, start, end in walk(data):
        if path[-1] == b"trak":
            tracks.append({})
        elif tracks and b"trak" in path:
            tracks[-1].setdefault(path[-1], (start, end))
    out = []
    for boxes in tracks:
        codec, duration = "", 0.0
        if b"stsd" in boxes and boxes[b"stsd"][1] - boxes[b"stsd"][0] >= 16:
            codec = data[boxes[b"stsd"][0] + 12 : boxes[b"stsd"][0] + 16].decode("latin-1")
        scale = 0
        if b"mdhd" in boxes:
            at, stop = boxes[b"mdhd"]
            wide = at < stop and data[at] == 1
            if stop - at >= (32 if wide else 20):
                scale = struct.unpack_from(">I", data, at + (20 if wide else 12))[0]
        steps = _table(data, boxes.get(b"stts"), width=2)
        if scale:
            duration = int((steps[:, 0] * steps[:, 1]).sum()) / scale
        offset, size = samples(data, boxes)
        keys = _table(data, boxes[b"stss"])[:, 0] - 1 if b"stss" in boxes else np.arange(len(offset))
        keys = keys[(keys >= 0) & (keys < len(offset))]
        out.append({"codec": codec, "duration": duration, "offset": offset, "size": size, "keyframes": np.stack([offset[keys], size[keys]], 1)})
    return {"tracks": out}


def sample_bytes(data: bytes, track: dict) -> bytes:
    """The stored bytes of a track's samples, neighbours read together."""
    offset, size = track["offset"], track["size"]
    if not len(offset):
        return b""
    cut = np.flatnonzero(np.concatenate(([True], offset[1:] != offset[:-1] + size[:-1])))
    ends = np.append(cut[1:], len(offset)) - 1
    return b"".join(data[offset[a] : offset[b] + size[b]] for a, b in zip(cut, ends))


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, 1):
            raw = list(byte_rows(part.column(1)))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array([wrap(x) for x in raw], pa.binary())],
                ["id", "n_bytes", "media"],
            )


TRACK = "struct<codec:string,duration:double,n_frames:long,keyframes:array<struct<offset:long,length:long>>>"


def _tracks(files: list[list[dict]]) -> pa.Array:
    """The tracks of each file as a list of structs; keyframes go from numpy to Arrow as whole columns."""
    every = [track for tracks in files for track in tracks]
    keys = np.concatenate([np.empty((0, 2), np.int64), *(track["keyframes"] for track in every)])
    ends = np.cumsum([0, *(len(track["keyframes"]) for track in every)])
    ranges = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1])], ["offset", "length"]))
    columns = {
        "codec": pa.array([track["codec"] for track in every], pa.string()),
        "duration": pa.array([track["duration"] for track in every], pa.float64()),
        "n_frames": pa.array([len(track["offset"]) for track in every], pa.int64()),
        "keyframes": ranges,
    }
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, files)]), pa.int32()), pa.StructArray.from_arrays(list(columns.values()), list(columns)))


def _describe(batches: Iterator[pa.RecordBatch], payload: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, 1):
            files, digests = [], []
            for data in byte_rows(part.column(1)):
                files.append(read_media(data)["tracks"])
                if payload:
                    read = b"".join(sample_bytes(data, track) for track in files[-1])
                    digests.append((len(read), hashlib.sha256(read).hexdigest(), zlib.crc32(read[-32:]), len(data), hashlib.sha256(data).hexdigest()))
            values = [part.column(0), *part.columns[2:], _tracks(files)]
            names = ["id", *batch.schema.names[2:], "tracks"]
            if payload:
                kinds = {"payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string()}
                values += [pa.array(column, kind) for column, kind in zip(zip(*digests), kinds.values())]
                names += kinds
            yield pa.RecordBatch.from_arrays(values, names)


def store_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's text (null: empty) as a media file: the id column, n_bytes, media."""
    ship(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    narrow = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return spread(narrow).mapInArrow(_store, f"id {kind}, n_bytes long, media binary").withColumnRenamed("id", id_col)


def media_columns(df: DataFrame, media_col: str = "media", id_col: str = "doc_id", keep: tuple[str, ...] = (), payload: bool = False) -> DataFrame:
    """The id column, those in `keep`, then tracks: codec, duration, n_frames and keyframes (offset and length
    in the file) of each track, in the order of the file.

    Bytes that hold no track (null, empty or broken ones too) give an empty array. With `payload`, also
    digests of the stored bytes of the samples of all tracks, and of the file.
    """
    ship(df.sparkSession)
    kind = {c: df.schema[c].dataType.simpleString() for c in (id_col, *keep)}
    more = ", payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string" if payload else ""
    schema = ", ".join([f"id {kind[id_col]}", *(f"k{i} {kind[c]}" for i, c in enumerate(keep)), f"tracks array<{TRACK}>" + more])
    narrow = df.select(F.col(id_col).alias("id"), F.col(media_col).alias("m"), *(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)))
    out = narrow.mapInArrow(lambda batches: _describe(batches, payload), schema)
    return out.withColumnsRenamed({"id": id_col} | {f"k{i}": c for i, c in enumerate(keep)})


def text_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store each text as media in the shared folder, read it back and describe it.

    Returns the id column, n_bytes, the columns of `media_columns` with payload digests, and
    feature: codec, seconds, frames, keyframes and the last one's byte range as text. Equal texts
    (a null one equals an empty one) have equal values; repeated rows and ids give a row each; an
    empty table gives no rows; other columns are not read.
    """
    files = stored(store_texts(df, id_col, text_col), "media")
    read = media_columns(files, id_col=id_col, keep=("n_bytes",), payload=True)
    track = F.get("tracks", F.lit(0))
    last = F.element_at(track["keyframes"], -1)
    feature = F.format_string(
        "codec=%s;seconds=%.6f;frames=%d;keyframes=%d;last=%d+%d",
        F.trim(track["codec"]), track["duration"], track["n_frames"], F.size(track["keyframes"]).cast("long"), last["offset"], last["length"],
    )
    return read.withColumn("feature", feature)
