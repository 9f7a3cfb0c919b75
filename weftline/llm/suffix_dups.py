"""Repeated byte strings by a distributed, prefix-aware merge sort of suffixes (operator 4).

A byte goes if it lies in a string of ``window`` bytes that also starts
somewhere else. Any such string holds its minimiser (the least hash among its
``gram``-byte strings, leftmost), and equal strings hold it at the same offset.
So the suffixes that start at minimisers suffice, and of those only the ones
whose gram occurs twice or more.

Each is sorted by what follows it, then by what precedes it (backwards): tasks
sort runs, front-code them (length shared with the record before, and the rest)
and exchange slices between splitters; a loser tree merges the slices, and as
every record carries the prefix it shares with the last winner, known prefixes
are never compared again. The merge yields the longest common prefixes, and
with both contexts at hand each neighbour shows how far a match extends either
way. A second sort, by what precedes and then by what follows, takes one record
of each distinct context that shares its gram. Longest extensions to either
side bound what can still be repeated; strings within the bounds that no single
neighbour has shown are sorted as full strings by the same merge, which settles
them exactly.

Equal records are told apart by document and place, so splitters cut through
any group and no task has to hold one.

Defined results: null text is empty; texts shorter than the window lose
nothing; equal rows are copies of each other and lose all bytes if long enough;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left, bisect_right
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from weftline.llm.common import as_bytes, chunks, mixed, partitions, spool, table, trim
from weftline.llm.near_dup import _byte_values, powers

WINDOW, GRAM = 200, 32
#: Records of a run that one task sorts at once, and of a front-coded block.
RUN, BLOCK = 60_000, 1024
#: Offsets that are settled together, and bits (as a power of two) that tell which grams and cores have open offsets.
SPREAD, BITS = 16, 25
#: Earlier records in sorted order that a record is held against.
NEIGHBOURS = 8
#: Bits of a place among the texts that are handled at once; Spark's own limit of a text is lower.
PLACE_BITS = 31
#: Bytes that UTF-8 never has: the end of the first context, and of the key.
MID, END = b"\xff", b"\xfe"
TIE, TIE_SIZE = ">QQI", 20
NO_ID = -(1 << 63)
#: One anchor in so many also carries its key, from which splitters are drawn.
SAMPLED = 128


# ---- front-coded runs and their merge ----


def common(x: bytes, y: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(x), len(y))
    if x[:n] == y[:n]:
        return n
    d = int.from_bytes(x[:n], "big") ^ int.from_bytes(y[:n], "big")
    return n - (d.bit_length() + 7) // 8


def _neighbours_share(records: list[bytes]) -> list[int]:
    """Of each record, the length of its common prefix with the one before."""
    table = np.array(records, "S")
    table = table.view(np.uint8).reshape(len(records), -1)
    apart = table[1:] != table[:-1]
    size = np.fromiter(map(len, records), np.int64, len(records))
    least = np.minimum(size[1:], size[:-1])
    first = apart.argmax(1)
    first[~apart[np.arange(len(first)), first]] = table.shape[1]  # the padding hides what follows
    return [0, *np.minimum(first, least).tolist()]


def front_code(records: list[bytes]) -> bytes:
    """A sorted run: shared lengths, rest lengths, rests; compressed."""
    import zstandard

    shared = _neighbours_share(records)
    rests = [r[k:] for r, k in zip(records, shared, strict=True)]
    head = np.array([shared, list(map(len, rests))], np.uint16).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(struct.pack("<I", len(records)) + head + b"".join(rests))


def decoded(blob: bytes) -> Iterator[tuple[bytes, int]]:
    """(record, length shared with the one before)."""
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(blob)
    n = struct.unpack_from("<I", data)[0]
    shared, rest = np.frombuffer(data, np.uint16, 2 * n, 4).reshape(2, n).tolist()
    at, last = 4 + 4 * n, b""
    for k, m in zip(shared, rest, strict=True):
        last = last[:k] + data[at : at + m]
        at += m
        yield last, k


def _stream(blobs: list[bytes]) -> Iterator[tuple[bytes, int]]:
    last = b""
    for b in blobs:
        for i, (r, k) in enumerate(decoded(b)):
            yield r, (common(last, r) if i == 0 else k)
        last = r


def merged(runs: list[Iterator[tuple[bytes, int]]]) -> Iterator[tuple[bytes, int]]:
    """All records in order, each with the length it shares with the one before, by a loser tree.

    ``shared[i]`` is what stream i's head shares with the last winner. Of two heads
    the one that shares more is smaller; only equals are compared, from there on.
    """
    k = len(runs)
    rec: list[bytes | None] = []
    for r in runs:
        rec.append(next(r, (None, 0))[0])
    shared = [0] * k
    size = 1 << max(k - 1, 0).bit_length()
    rec += [None] * (size - k)
    shared += [0] * (size - k)

    def play(i: int, j: int) -> tuple[int, int]:
        x, y = rec[i], rec[j]
        if y is None:
            return i, j
        if x is None:
            return j, i
        a, b = shared[i], shared[j]
        if a > b:
            return i, j
        if b > a:
            return j, i
        p, q = x[a:], y[a:]
        c = a + common(p, q)
        if p <= q:
            shared[j] = c
            return i, j
        shared[i] = c
        return j, i

    tree = [0] * size
    level = list(range(size))
    node = size
    while len(level) > 1:
        node //= 2
        nxt = []
        for i in range(0, len(level), 2):
            w, l = play(level[i], level[i + 1])
            tree[node + i // 2] = l
            nxt.append(w)
        level = nxt
    win = level[0]
    while rec[win] is not None:
        yield rec[win], shared[win]
        rec[win], shared[win] = next(runs[win], (None, 0))
        at = (size + win) // 2
        while at:
            win, tree[at] = play(win, tree[at])
            at //= 2


def blocks(records: list[bytes], run: int, splitters: list[bytes]) -> Iterator[tuple[int, int, int, bytes]]:
    """(part, run, seq, blob) of a list of records, sorted here."""
    records.sort()
    start, seq = 0, 0
    while start < len(records):
        part = bisect_right(splitters, records[start])
        end = len(records) if part == len(splitters) else bisect_left(records, splitters[part], start)
        for a in range(start, end, BLOCK):
            yield part, run, seq, front_code(records[a : min(a + BLOCK, end)])
            seq += 1
        start = end


ROUTED = "part int, run long, seq int, blob binary"


def _routed(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["part", "run", "seq", "blob"])


def merge_parts(routed: DataFrame, parts: int, reducer: Callable[[Iterator[tuple[bytes, int]]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Hands each part's records, merged, to ``reducer``. A part's blobs (compressed) are held by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, {}
        for b in batches:
            for p, r, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True):
                if p != part and held:
                    yield from reducer(merged([_stream(x) for x in held.values()]))
                    held = {}
                part = p
                held.setdefault(r, []).append(blob)
        if held:
            yield from reducer(merged([_stream(x) for x in held.values()]))
        held = {}
        trim()

    return routed.repartition(parts, "part").sortWithinPartitions("part", "run", "seq").mapInArrow(run, schema)


def drawn(keys: DataFrame, parts: int) -> list[bytes]:
    """Splitters for ``parts`` parts from the column ``key``: 8 keys a part reach the driver."""
    some = keys.select("key", F.xxhash64("key").alias("h")).orderBy("h").limit(8 * parts).select("key").toPandas().key
    ordered = sorted(bytes(x) for x in some)
    return sorted({ordered[len(ordered) * i // parts] for i in range(1, parts)}) if ordered else []


# ---- anchors ----


def anchors(texts: list[str], window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes, np.ndarray]:
    """Minimisers of all texts: gram hashes, texts they belong to, places in those; all bytes, and where each text starts.

    A gram is ranked by the high bits of its hash, as many in every chunk, then by place, so the least rank of a
    window holds the leftmost least gram's place itself, and equal windows hold it at the same offset.
    """
    data, starts = as_bytes(texts)
    n, w = len(data), window - gram + 1
    none = np.zeros(0, np.int64)
    if n <= window:
        return none.view(np.uint64), none, none, data.tobytes(), starts
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_byte_values()[data] * up[:-1], out=total[1:])
    g = n - gram + 1
    h = mixed((total[gram:] - total[:g]) * down[:g])
    bits = np.uint64(PLACE_BITS)
    if n >> PLACE_BITS:
        raise ValueError("texts of one chunk are too long")
    # Least rank of w neighbouring grams: running minima of blocks of w, from both sides.
    x = np.full(-(-g // w) * w, np.iinfo(np.uint64).max, np.uint64)
    x[:g] = (h >> bits << bits) | np.arange(g, dtype=np.uint64)
    x = x.reshape(-1, w)
    right, left = np.minimum.accumulate(x, 1).reshape(-1), np.minimum.accumulate(x[:, ::-1], 1)[:, ::-1].reshape(-1)
    m = n - window + 1
    least = np.minimum(left[:m], right[w - 1 : w - 1 + m])
    ends = np.zeros(n + 1, np.int32)
    ends[starts[1:]] = 1  # after each text's last byte comes one that is not its own
    ends = np.cumsum(ends)
    whole = ends[window : window + m] == ends[:m]
    places = (least[whole] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    places = places[np.diff(places, prepend=-1) != 0]
    doc = np.searchsorted(starts, places, "right") - 1
    return h[places], doc, places - starts[doc], data.tobytes(), starts


def key_at(raw: bytes, pos: int, window: int, gram: int, tie: bytes) -> bytes:
    """What follows an anchor, then what precedes it backwards, then who it is."""
    return raw[pos : pos + window] + MID + raw[max(0, pos - window + gram) : pos][::-1] + END + tie


def _tie(doc: int, version: int, pos: int) -> bytes:
    return struct.pack(TIE, doc + (1 << 63), version + (1 << 63), pos)


# ---- the two directions ----


class Entry:
    __slots__ = ("back", "boundary", "core", "done", "first", "found", "mid", "reach", "shared", "tail", "tie")

    def __init__(self, core: bytes, tail: bytes, tie: bytes, shared: int):
        self.core, self.tail, self.tie, self.shared = core, tail, tie, shared
        self.mid = core.index(MID)
        self.back = core[self.mid + 1 : -1]
        self.reach, self.found, self.done, self.boundary, self.first = 0, [], False, False, False


def scan(records: Iterator[tuple[bytes, int]], window: int, base: int, on_leave: Callable[[Entry, int], None], read: Callable[[Entry], None] | None = None) -> None:
    """Holds each record against its neighbours. ``base``: bytes of the first context that both must share at least.

    An entry leaves with ``reach`` (the most it shares of its first context with any record), ``found`` (pairs of
    lengths shared of the first and the second context, whose sum allows a match), and ``done`` if an equal exists.
    """
    recent: deque[Entry] = deque()
    last: Entry | None = None
    for rec, shared in records:
        end = rec.index(END) + 1
        e = Entry(rec[:end], rec[end + TIE_SIZE :], rec[end : end + TIE_SIZE], shared)
        if read:
            read(e)
        if last is None:
            e.boundary = True
        run = shared
        mid, back, nearest = e.mid, e.back, True
        for p in reversed(recent):
            r = run if run < mid else mid
            if p.mid < r:
                r = p.mid
            if r < base:
                break
            if nearest:
                if e.reach < r:
                    e.reach = r
                if p.reach < r:
                    p.reach = r
                if run >= end and len(p.core) == end:
                    for x in (e, p):
                        if not x.done:
                            x.done = True
                            x.found.append((mid, end - mid - 2))
                    break
                nearest = False
            if not (e.done and p.done) and r + min(len(back), len(p.back)) >= window:
                k = common(back, p.back)
                if r + k >= window:
                    for x in (e, p):
                        if not x.done:
                            for a, b in x.found:
                                if a >= r and b >= k:
                                    break
                            else:
                                x.found.append((r, k))
            if p.shared < run:
                run = p.shared
        e.first = not (last is not None and shared >= end and len(last.core) == end)
        recent.append(e)
        if len(recent) > NEIGHBOURS:
            on_leave(recent.popleft(), recent[0].shared)
        last = e
    if last is not None:
        last.boundary = True
    while recent:
        e = recent.popleft()
        on_leave(e, recent[0].shared if recent else 0)


FOUND = "kind int, doc long, version long, start long, stop long, key binary, data binary"
SPAN, SORTED, OPEN = 0, 1, 2


def _found(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in FOUND.split(", ")])


def _span(tie: bytes, before: int, after: int) -> tuple:
    doc, version, pos = struct.unpack(TIE, tie)
    return SPAN, doc - (1 << 63), version - (1 << 63), pos - before, pos + after, None, None


def _spans(e: Entry, pairs: list[tuple[int, int]]) -> list[tuple]:
    """Spans of (before, after) pairs around an entry's place, merged where they meet (all hold the place)."""
    return [_span(e.tie, max(a for a, _ in pairs), max(b for _, b in pairs))] if pairs else []


def forward(window: int, gram: int) -> Callable[[Iterator[tuple[bytes, int]]], Iterator[pa.RecordBatch]]:
    """Spans that following context shows, and the records of the second sort as front-coded blocks."""

    def reducer(records: Iterator[tuple[bytes, int]]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        mirrored: list[bytes] = []

        def leave(e: Entry, next_shared: int) -> None:
            rows.extend(_spans(e, [(b, a) for a, b in e.found]))
            if e.done and not e.first and not e.boundary:
                return
            if not (e.boundary or e.shared >= gram or next_shared >= gram):
                return
            ahead, behind = e.core[: e.mid], e.core[e.mid + 1 : -1]
            reach = e.mid if e.boundary else e.reach
            state = struct.pack(f">HBB{2 * len(e.found)}H", reach, e.done, len(e.found), *(v for p in e.found for v in p))
            mirrored.append(ahead[:gram][::-1] + behind + MID + ahead[gram:] + END + e.tie + state)

        scan(records, window, gram, leave)
        if mirrored:
            mirrored.sort()
            for a in range(0, len(mirrored), BLOCK):
                part = mirrored[a : a + BLOCK]
                rows.append((SORTED, None, None, None, None, part[0], front_code(part)))
        for a in range(0, len(rows), 5000):
            yield _found(rows[a : a + 5000])

    return reducer


def _state(tail: bytes) -> tuple[int, bool, list[tuple[int, int]]]:
    reach, done, n = struct.unpack_from(">HBB", tail)
    flat = struct.unpack_from(f">{2 * n}H", tail, 4)
    return reach, bool(done), list(zip(flat[::2], flat[1::2], strict=True))


def backward(window: int, gram: int) -> Callable[[Iterator[tuple[bytes, int]]], Iterator[pa.RecordBatch]]:
    """Spans that preceding context shows, and offsets that only a full comparison can settle."""

    def reducer(records: Iterator[tuple[bytes, int]]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def read(e: Entry) -> None:
            e.done = _state(e.tail)[1]

        def leave(e: Entry, _: int) -> None:
            reach, done, known = _state(e.tail)
            behind = e.mid - gram
            pairs = [(a - gram, b + gram) for a, b in e.found]
            rows.extend(_spans(e, pairs))
            if done or e.done:
                return
            most = behind if e.boundary else max(e.reach - gram, 0)
            low, high = max(window - reach, 0), min(most, behind)
            left = set(range(low, high + 1))
            for a, b in pairs + [(b, a) for a, b in known]:
                left.difference_update(range(window - b, a + 1))
            if left:
                around = e.core[:gram][::-1]
                for first, core in cores(e.core[gram : e.mid], around + e.core[e.mid + 1 : -1], window):
                    if here := left.intersection(range(first, first + SPREAD)):
                        rows.append((OPEN, None, None, min(here), max(here), core, around))

        scan(records, window, gram, leave, read)
        for a in range(0, len(rows), 5000):
            yield _found(rows[a : a + 5000])

    return reducer


def whole(window: int) -> Callable[[Iterator[tuple[bytes, int]]], Iterator[pa.RecordBatch]]:
    """Spans of full strings that equal a neighbour; splitters are bare strings here, so equals meet in one part."""

    def reducer(records: Iterator[tuple[bytes, int]]) -> Iterator[pa.RecordBatch]:
        rows, last = [], None
        for rec, shared in records:
            tie = rec[window + 1 : window + 1 + TIE_SIZE]
            if last is not None and shared >= window and tie != last:  # two anchors may have named one string
                rows += [_span(x, 0, window) for x in (last, tie)]
            last = tie
        for a in range(0, len(rows), 5000):
            yield _found(rows[a : a + 5000])

    return reducer


def cores(behind: bytes, ahead: bytes, window: int) -> Iterator[tuple[int, bytes]]:
    """For offsets [first, first + SPREAD): first, and a digest of what all strings at these offsets have in common.

    It is all but SPREAD - 1 bytes of any of them, so records that agree on it are nearly all that can match.
    """
    import xxhash

    for first in range(max(0, (window - len(ahead)) // SPREAD * SPREAD), len(behind) + 1, SPREAD):
        yield first, xxhash.xxh3_128_digest(bytes([first // SPREAD]) + behind[:first] + MID + ahead[: max(window - first - SPREAD + 1, 0)])


def bitmap(keys: DataFrame) -> bytes:
    """A bit for each hash of the column ``key``, compressed: 2 ** BITS of them whatever the count, so later joins only get more to sort out."""
    places = keys.select(F.pmod(F.crc32("key"), F.lit(1 << BITS)).cast("int").alias("place"))
    words = places.select(F.expr("place div 32").alias("word"), F.expr("shiftleft(1L, place % 32)").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(1 << (BITS - 5), np.uint32)
    out[words.word.to_numpy(np.int64)] = words.bits.to_numpy(np.int64).astype(np.uint32)
    return zlib.compress(out.tobytes(), 1)


def settle(open_: DataFrame, mirrored: DataFrame, window: int, gram: int, parts: int) -> DataFrame:
    """Spans among the strings at open offsets of all records that share what these have in common."""
    groups = spool(open_.groupBy("key").agg(F.min("start").alias("low"), F.max("stop").alias("high")), "open")
    packed_bits = bitmap(groups.select("key").union(open_.select("data").distinct()))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, mask = zlib.decompress(packed_bits), (1 << BITS) - 1

        def told(key: bytes) -> int:
            at = zlib.crc32(key) & mask
            return bits[at >> 3] >> (at & 7) & 1

        for b in batches:
            for blob in b.column(0).to_pylist():
                rows = []
                for r, _ in decoded(blob):
                    around = r[:gram][::-1]
                    if not told(around):
                        continue
                    end = r.index(END)
                    mid = r.index(MID)
                    behind, ahead = r[gram:mid], around + r[mid + 1 : end]
                    rows += [(core, behind, ahead, r[end + 1 : end + 1 + TIE_SIZE]) for _, core in cores(behind, ahead, window) if told(core)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*rows, strict=True)], ["core", "behind", "ahead", "tie"])

    records = mirrored.select("data").mapInArrow(unpack, "core binary, behind binary, ahead binary, tie binary")
    rows = records.join(groups, records["core"] == groups["key"]).select("behind", "ahead", "tie", "low", "high")

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []

        def flush() -> Iterator[pa.RecordBatch]:
            held.sort()
            for a in range(0, len(held), BLOCK):
                part = held[a : a + BLOCK]
                yield pa.RecordBatch.from_arrays([pa.array([part[0]], pa.binary()), pa.array([front_code(part)], pa.binary())], ["key", "data"])
            held.clear()

        for b in batches:
            for behind, ahead, tie, low, high in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                doc, version, pos = struct.unpack(TIE, tie)
                for o in range(max(low, window - len(ahead)), min(high, len(behind)) + 1):
                    held.append(behind[:o][::-1] + ahead[: window - o] + END + struct.pack(TIE, doc, version, pos - o))
                if len(held) > RUN:
                    yield from flush()
        yield from flush()
        trim()

    found = spool(rows.mapInArrow(strings, "key binary, data binary"), "strings")
    splitters = [s[:window] for s in drawn(found, parts)]
    return merge_parts(routed(found, sorted(set(splitters))), parts, whole(window), FOUND)


def routed(blocks_: DataFrame, splitters: list[bytes]) -> DataFrame:
    """Blocks (key, data) cut at the splitters; every block counts as a run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, n = TaskContext.get().partitionId(), 0
        for b in batches:
            rows = []
            for blob in b.column(0).to_pylist():
                rows += blocks([r for r, _ in decoded(blob)], (task << 32) + n, splitters)
                n += 1
            if rows:
                yield _routed(rows)
        trim()

    return blocks_.select("data").mapInArrow(run, ROUTED)


def spans(texts: DataFrame, packed: DataFrame, window: int, gram: int) -> DataFrame:
    """texts (doc, version, text), packed (doc, version, packed) -> doc, version, start, stop of strings to remove; they may overlap."""
    spark = texts.sparkSession

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                docs, versions, some = (b.column(i).slice(at, 512).to_pylist() for i in range(3))
                some = [x or "" for x in some]
                docs, versions = np.array(docs, np.int64), np.array(versions, np.int64)
                for i, j in chunks(some):
                    h, doc, place, flat, starts = anchors(some[i:j], window, gram)
                    own, version = docs[i:j][doc], versions[i:j][doc]
                    lot = mixed((place.astype(np.uint64) << np.uint64(20)) ^ version.view(np.uint64)) % np.uint64(SAMPLED) == 0
                    keys: list[bytes | None] = [None] * len(h)
                    for k in np.flatnonzero(lot).tolist():
                        a, e = int(starts[doc[k]]), int(starts[doc[k] + 1]) - 1
                        keys[k] = key_at(flat[a:e], int(place[k]), window, gram, _tie(int(own[k]), int(version[k]), int(place[k])))
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(own), pa.array(version), pa.array(place.astype(np.int32)), pa.array(keys, pa.binary())], ["h", "doc", "version", "pos", "key"])
        trim()

    found = spool(texts.mapInArrow(find, "h long, doc long, version long, pos int, key binary"), "grams")
    # As a table of its own, so that the join is one of two plain exchanges, whose hot keys can be split.
    twice = spool(found.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("h").alias("h_")), "twice")
    shared = spool(found.join(twice, found["h"] == twice["h_"], "left_semi").select("doc", "version", "pos", "key"), "anchors")
    parts = max(2 * partitions(spark), shared.count() // 100_000)
    splitters = drawn(shared.where("key IS NOT NULL"), parts)
    places = shared.groupBy(F.col("doc").alias("p_doc"), F.col("version").alias("p_version")).agg(F.collect_list("pos").alias("places"))
    wanted = packed.join(places, (packed["doc"] == places["p_doc"]) & (packed["version"] == places["p_version"])).select("doc", "version", "packed", "places")

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, n, held = TaskContext.get().partitionId(), 0, []

        def flush() -> pa.RecordBatch:
            rows = list(blocks(held, (task << 32) + n, splitters))
            held.clear()
            return _routed(rows)

        for b in batches:
            for at in range(0, b.num_rows, 512):
                for doc, version, packed_, places_ in zip(*(b.column(i).slice(at, 512).to_pylist() for i in range(4)), strict=True):
                    raw = unpacked(packed_)
                    held += [key_at(raw, p, window, gram, _tie(doc, version, p)) for p in places_]
                    if len(held) >= RUN:
                        yield flush()
                        n += 1
        if held:
            yield flush()
        trim()

    one = spool(merge_parts(wanted.mapInArrow(records, ROUTED), parts, forward(window, gram), FOUND), "forward")
    mirrored = one.where(F.col("kind") == SORTED)
    two = spool(merge_parts(routed(mirrored, drawn(mirrored, parts)), parts, backward(window, gram), FOUND), "backward")
    out = one.where(F.col("kind") == SPAN).unionByName(two.where(F.col("kind") == SPAN))
    open_ = two.where(F.col("kind") == OPEN)
    if not open_.isEmpty():
        out = out.unionByName(settle(open_, mirrored, window, gram, parts))
    return out.select("doc", "version", "start", "stop")


def keyed(docs: DataFrame, id_col: str, text_col: str, rest: bool = False) -> DataFrame:
    """doc, version (of the text), text; ``rest``: all other columns in one."""
    text = F.col(text_col).cast("string")
    others = [F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text_col)).alias("rest")] if rest else []
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("version"), text.alias("text"), *others)


def pack_text(rows: DataFrame) -> DataFrame:
    """``keyed`` rows with the text as ``packed``, compressed UTF-8, so that exchanges carry less."""
    rest = "rest" in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        z = zstandard.ZstdCompressor(level=1)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                packed = pa.array([z.compress((x or "").encode("utf-8", "surrogatepass")) for x in b.column(2).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), packed, *([b.column(3)] if rest else [])], ["doc", "version", "packed", *(["rest"] if rest else [])])

    schema = StructType([rows.schema["doc"], rows.schema["version"], StructField("packed", BinaryType())] + ([rows.schema["rest"]] if rest else []))
    return rows.mapInArrow(run, schema)


def unpacked(packed: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(packed) if packed else b""


def without(raw: bytes, starts: list[int] | None, stops: list[int] | None) -> tuple[bytes, int, int]:
    """What is left of ``raw``, how many bytes went, and in how many runs."""
    kept, removed, n, end = [], 0, 0, 0
    for s, e in sorted(zip(starts or (), stops or (), strict=True)):
        if s > end or n == 0:
            kept.append(raw[end:s])
            removed, n, end = removed + e - s, n + 1, e
        elif e > end:
            removed, end = removed + e - end, e
    kept.append(raw[end:])
    return b"".join(kept), removed, n


def _with_spans(rows: DataFrame, window: int, gram: int) -> DataFrame:
    texts = rows.select("doc", "version", "text")
    packed = pack_text(rows)
    found = spans(texts, pack_text(texts), window, gram)
    gone = found.groupBy(F.col("doc").alias("g_doc"), F.col("version").alias("g_version")).agg(F.collect_list(F.struct("start", "stop")).alias("gone"))
    joined = packed.join(gone, (packed["doc"] == gone["g_doc"]) & (packed["version"] == gone["g_version"]), "left")
    return joined.select(*(c for c in packed.columns if c != "version"), F.col("gone.start").alias("starts"), F.col("gone.stop").alias("stops"))


def dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept binary: what is left of each text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                rows = []
                for doc, packed, starts, stops in zip(*(b.column(i).slice(at, 512).to_pylist() for i in range(4)), strict=True):
                    raw = unpacked(packed)
                    kept, removed, n = without(raw, starts, stops)
                    rows.append((None if doc == NO_ID else doc, len(raw), removed, n, kept))
                kinds = [pa.int64()] * 4 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return _with_spans(keyed(docs, id_col, text_col), window, gram).mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def clean(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with what is left of each text (characters that a cut splits go whole); texts that lose all are left out."""
    rows = _with_spans(keyed(docs, id_col, text_col, rest=True), window, gram)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                some = b.slice(at, 512)
                texts, removed = [], []
                for packed, starts, stops in zip(*(some.column(i).to_pylist() for i in (1, 3, 4)), strict=True):
                    kept, n, _ = without(unpacked(packed), starts, stops)
                    texts.append(kept.decode("utf-8", "ignore"))
                    removed.append(n)
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(removed, pa.int64()), some.column(2)], ["text", "removed", "rest"])

    cleaned = rows.mapInArrow(cut, StructType([StructField("text", StringType()), StructField("removed", LongType()), rows.schema["rest"]]))
    return cleaned.where("removed = 0 OR trim(text) <> ''").select(*(F.col("text").alias(c) if c == text_col else F.col(f"rest.`{c}`") for c in docs.columns))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
