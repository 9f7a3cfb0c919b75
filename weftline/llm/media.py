"""ISO media containers (operator 3): write, walk, and index without decoding.

A payload becomes a track of uncompressed 8-bit 16 x 12 pictures (192 bytes a
sample) in an ISO base media file: ``ftyp``, ``moov`` with the sample tables
``stts stsc stsz stss stco|co64``, ``mdat``. Reading walks the nested boxes,
decodes the tables, and derives from them alone the codec, the duration and
the byte ranges of the key frames; sample bytes are touched only by ``read``.

Defined results: a null text counts as empty; an empty payload is one sample
of blanks; media that is null or malformed (boxes beyond their parents or nested
without end, tables that promise more than the file holds) probes to nulls and
a non-null ``error``; repeated rows stay repeated; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import id_text, table, text_batches

WIDTH, HEIGHT, SAMPLE = 16, 12, 192
TIMESCALE, TICKS = 12_800, 512  # 25 pictures a second
KEY_EVERY, CHUNK_SAMPLES = 12, 64
#: Boxes whose content is boxes, and how many bytes come before those.
NESTED = {b"moov": 0, b"trak": 0, b"mdia": 0, b"minf": 0, b"dinf": 0, b"stbl": 0, b"edts": 0, b"moof": 0, b"traf": 0, b"udta": 0}
#: No known use nests boxes so deep.
DEPTH = 32
MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def _full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", flags), *parts)


def padded(raw: bytes) -> bytes:
    """Blanks up to a positive multiple of the sample size."""
    return raw + b" " * (-len(raw) % SAMPLE or (0 if raw else SAMPLE))


#: One component, luminance, of 8 unsigned bits a sample, without tiles or padding: the component list and its layout.
MONOCHROME = _box(b"cmpd", struct.pack(">IH", 1, 0)) + _full(b"uncC", struct.pack(">IIHBBB4B5I", 0, 1, 0, 7, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0))


def mux(payload: bytes) -> bytes:
    """The container of a payload whose length is a positive multiple of SAMPLE."""
    n = len(payload) // SAMPLE
    chunks, rest = divmod(n, CHUNK_SAMPLES)
    keys = range(1, n + 1, KEY_EVERY)
    runs = ([(1, CHUNK_SAMPLES)] if chunks else []) + ([(chunks + 1, rest)] if rest else [])
    entry = _box(b"uncv", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", WIDTH, HEIGHT, 0x480000, 0x480000, 0, 1), bytes(32), struct.pack(">HH", 8, 0xFFFF), MONOCHROME)

    def head(offset: int, wide: bool) -> bytes:
        at = range(offset, offset + len(payload), SAMPLE * CHUNK_SAMPLES)
        stbl = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, n, TICKS)),
            _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", a, k, 1) for a, k in runs)),
            _full(b"stsz", struct.pack(">II", SAMPLE, n)),
            _full(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)),
            _full(b"co64" if wide else b"stco", struct.pack(f">I{len(at)}{'Q' if wide else 'I'}", len(at), *at)),
        )
        length = n * TICKS
        mdia = _box(
            b"mdia",
            _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, TIMESCALE, length, 0x55C4, 0)),
            _full(b"hdlr", bytes(4), b"vide", bytes(12), b"\0"),
            _box(b"minf", _full(b"vmhd", bytes(8), flags=1), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), stbl),
        )
        tkhd = _full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, length), bytes(16), MATRIX, struct.pack(">II", WIDTH << 16, HEIGHT << 16), flags=7)
        mvhd = _full(b"mvhd", struct.pack(">IIIIIH", 0, 0, TIMESCALE, length, 0x10000, 0x100), bytes(10), MATRIX, bytes(24), struct.pack(">I", 2))
        return _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isommp42") + _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))

    wide = len(payload) > 0xF0000000
    size = len(head(0, wide)) + (16 if wide else 8)
    mdat = struct.pack(">I4sQ", 1, b"mdat", len(payload) + 16) if wide else struct.pack(">I4s", len(payload) + 8, b"mdat")
    return head(size, wide) + mdat + payload


def walk(data: bytes) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path, first byte, end) of every box's content, parents first. Boxes deeper than DEPTH are an error."""
    open_: list[tuple[int, int, tuple[bytes, ...]]] = [(0, len(data), ())]  # where to go on, end, path
    while open_:
        start, end, path = open_.pop()
        if start + 8 > end:
            continue
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if body + 8 > end:
                raise ValueError("box header beyond its parent")
            size, body = struct.unpack_from(">Q", data, body)[0], body + 8
        elif size == 0:
            size = end - start
        if size < body - start or start + size > end:
            raise ValueError(f"box {kind!r} beyond its parent")
        here = (*path, kind)
        if len(here) > DEPTH:
            raise ValueError("boxes are nested too deep")
        yield here, body, start + size
        open_.append((start + size, end, path))
        if kind in NESTED:
            open_.append((body + NESTED[kind], start + size, here))


@dataclass
class Track:
    handler: bytes = b""
    codec: str = ""
    timescale: int = 0
    duration: int = 0
    width: int = 0
    height: int = 0
    starts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))


def _numbers(data: bytes, at: int, end: int, count: int, kind: str) -> np.ndarray:
    if count < 0 or at + count * np.dtype(kind).itemsize > end:
        raise ValueError("sample table beyond its box")
    return np.frombuffer(data, kind, count, at).astype(np.int64)


def tracks(data: bytes) -> list[Track]:
    """Every track's description and sample byte ranges, from the boxes alone."""
    out: list[Track] = []
    tables: dict[bytes, tuple[int, int]] = {}

    def close() -> None:
        if not out:
            return
        if b"stsz" not in tables:
            raise ValueError("a track without sample sizes")
        t, u = out[-1], struct.unpack_from
        at, end = tables[b"stsz"]
        size, n = u(">II", data, at + 4)
        if n * size > len(data):
            raise ValueError("more samples than bytes")
        t.sizes = np.full(n, size, np.int64) if size else _numbers(data, at + 12, end, n, ">u4")
        kind = b"co64" if b"co64" in tables else b"stco"
        at, end = tables[kind]
        offsets = _numbers(data, at + 8, end, u(">I", data, at + 4)[0], ">u8" if kind == b"co64" else ">u4")
        at, end = tables[b"stsc"]
        runs = _numbers(data, at + 8, end, 3 * u(">I", data, at + 4)[0], ">u4").reshape(-1, 3)
        if len(runs) and (runs[0, 0] != 1 or (np.diff(runs[:, 0]) < 1).any() or runs[-1, 0] > len(offsets)):
            raise ValueError("runs of chunks out of order")
        per = np.repeat(runs[:, 1], np.diff(runs[:, 0], append=len(offsets) + 1))
        if per.sum() != n or len(per) != len(offsets):
            raise ValueError("chunks and samples disagree")
        before = np.cumsum(t.sizes) - t.sizes
        first = np.cumsum(per) - per
        t.starts = np.repeat(offsets - before[first[: len(per)]], per) + before if n else t.sizes
        if n and (t.starts.min() < 0 or (t.starts + t.sizes).max() > len(data)):
            raise ValueError("sample beyond the file")
        if b"stss" in tables:
            at, end = tables[b"stss"]
            t.keys = _numbers(data, at + 8, end, u(">I", data, at + 4)[0], ">u4") - 1
            if len(t.keys) and (t.keys.min() < 0 or t.keys.max() >= n):
                raise ValueError("key frames beyond the samples")
        else:
            t.keys = np.arange(n)
        at, end = tables[b"stts"]
        runs = _numbers(data, at + 8, end, 2 * u(">I", data, at + 4)[0], ">u4").reshape(-1, 2)
        t.duration = int((runs[:, 0] * runs[:, 1]).sum())

    for path, at, end in walk(data):
        kind = path[-1]
        if kind == b"moof":
            raise ValueError("samples in fragments are not read")
        if kind == b"trak":
            close()
            tables = {}
            out.append(Track())
        elif b"trak" in path:
            if kind == b"mdhd":
                out[-1].timescale = struct.unpack_from(">I", data, at + (20 if data[at] else 12))[0]
            elif kind == b"tkhd":
                w, h = struct.unpack_from(">II", data, end - 8)
                out[-1].width, out[-1].height = w >> 16, h >> 16
            elif kind == b"hdlr" and path[-2] == b"mdia":
                out[-1].handler = data[at + 8 : at + 12]
            elif kind == b"stsd":
                out[-1].codec = data[at + 12 : at + 16].decode("latin-1")
            elif path[-2] == b"stbl":
                tables[kind] = (at, end)
    close()
    return out


def shown(found: list[Track]) -> Track:
    """The first picture track, or the first of a file without one."""
    return next((t for t in found if t.handler == b"vide"), found[0])


def read(data: bytes, t: Track) -> bytes:
    """The samples' bytes in order; neighbouring samples are read as one range."""
    if not len(t.starts):
        return b""
    cut = np.flatnonzero(t.starts[1:] != t.starts[:-1] + t.sizes[:-1]) + 1
    first, last = np.append(0, cut), np.append(cut, len(t.starts)) - 1
    return b"".join([data[a:b] for a, b in zip(t.starts[first].tolist(), (t.starts[last] + t.sizes[last]).tolist(), strict=True)])


def described(t: Track) -> str:
    """Codec, timing and key frames in one string; the ranges enter as a checksum."""
    ranges = np.stack([t.starts[t.keys], t.starts[t.keys] + t.sizes[t.keys]], 1)
    return f"{t.codec} {t.width}x{t.height} {t.duration}/{t.timescale} samples={len(t.sizes)} keys={len(t.keys)} ranges={zlib.crc32(ranges.astype('<i8').tobytes()):08x}"


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in text_batches(batches):
            raw = [(x or "").encode("utf-8", "surrogatepass") for x in texts]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(map(len, raw), pa.int64()), pa.array([mux(padded(x)) for x in raw], pa.binary())], ["doc_id", "n_bytes", "media"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def probe(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """A row per file: its first picture track's (or else first track's) codec, duration, size and key-frame byte ranges; no payload is decoded."""
    spec = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for x in b.column(1).to_pylist():
                try:
                    t = shown(tracks(x))
                    rows.append((t.codec, t.duration / t.timescale, t.width, t.height, len(t.sizes), [{"first": int(i), "end": int(i + n)} for i, n in zip(t.starts[t.keys], t.sizes[t.keys], strict=True)], None))
                except (TypeError, ValueError, IndexError, KeyError, struct.error, ZeroDivisionError) as e:
                    rows.append((None, None, None, None, None, None, f"{type(e).__name__}: {e}"))
            kinds = [pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int64(), spec, pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], ["doc_id", "codec", "seconds", "width", "height", "n_samples", "keyframes", "error"])

    chosen = media.select(F.col(id_col).cast("long").alias("doc_id"), F.col(media_col).cast("binary").alias("media"))
    return chosen.mapInArrow(run, "doc_id long, codec string, seconds double, width int, height int, n_samples long, keyframes array<struct<first:long,end:long>>, error string")


def digests(media: DataFrame) -> DataFrame:
    """What the stored bytes give back: payload digests, media digests, feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(6)]
            for x in b.column(2).to_pylist():
                t = shown(tracks(x))
                payload = read(x, t)
                for o, v in zip(out, (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(x), hashlib.sha256(x).hexdigest(), described(t)), strict=True):
                    o.append(v)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(o, k) for o, k in zip(out, kinds, strict=True))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(store(table(spark, sf_dir, "documents")))
