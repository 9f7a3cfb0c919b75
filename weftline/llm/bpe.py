"""Byte-level BPE without regular expressions (operator 2).

A text becomes an array of code-point classes. A finite automaton over those
classes knows, at each character, which kind of pre-token it stands in. Its
run is parallel: the transition functions of fixed-width blocks are composed
(composition is associative), an exclusive scan over the blocks' functions
gives each block's entry state, and all blocks then replay side by side.
Boundaries follow from neighbouring states alone. The distinct slices between
them are looked up in a cache, whose misses are merged pair by pair. Each id's
first byte is kept: decoding cuts texts and ranges of bytes there.

Defined results: a null text counts as empty; an empty text has no ids; texts
of any length are handled whole; rows repeat in the output as they do in the
input; columns other than the two that are read are ignored. The added tokens
of a JSON file are cut out of the text first, the leftmost and of these the
longest, and stand for themselves; a rank file has none.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from weftline.llm.common import chunks, id_text, table, text_batches, trim

# Classes of code points.
LETTER, NUMBER, BLANK, WHITE, OTHER, QUOTE, C_STMD, C_R, C_V, C_L, C_E, RESET = range(12)
# States: what the character just read belongs to.
(S_START, S_LETTER, S_NUMBER, S_WHITE, S_BLANK, S_OTHER, S_QUOTE, S_DONE1, S_R, S_V, S_L, S_DONE2) = range(12)
STATES = CLASSES = 12
#: Columns of a block; rows are the blocks of one chunk.
BLOCK = 256
#: Entries of a worker's cache, and the longest piece that stays in it: some 10 MB.
CACHE_ENTRIES, CACHED_BYTES = 150_000, 48
#: Text that is encoded at once, in characters and rows.
ENCODE_CHARS, ENCODE_ROWS = 2_000_000, 1024
#: Pieces of up to so many bytes are merged together; longer ones one by one, by a heap.
WIDTHS = (2, 4, 6, 8, 10, 12, 16, 24, 32, 64)
LONG = WIDTHS[-1]  # rows of them fit ROW_BITS


@lru_cache(1)
def class_table() -> np.ndarray:
    """The class of each code point, read off the library whose ids are to be matched, so that both know the same version of Unicode.

    A pattern of one property makes its encoder drop every character without it.
    """
    import tiktoken

    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    out = np.full(0x110000, OTHER, np.uint8)
    for pattern, c in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", WHITE)):
        probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        out[np.frombuffer(bytes(probe.encode_ordinary(every)).decode().encode("utf-32-le"), np.uint32)] = c
    out[32], out[ord("'")] = BLANK, QUOTE
    for letters, c in (("stmd", C_STMD), ("r", C_R), ("v", C_V), ("l", C_L), ("e", C_E)):
        out[[ord(x) for x in letters]] = c
    return out


@lru_cache(1)
def transitions() -> np.ndarray:
    """Next state by class * STATES + state."""
    t = np.empty((CLASSES, STATES), np.uint8)
    t[[LETTER, C_STMD, C_R, C_V, C_L, C_E]] = S_LETTER
    t[NUMBER], t[BLANK], t[WHITE], t[OTHER], t[RESET] = S_NUMBER, S_BLANK, S_WHITE, S_OTHER, S_START
    t[QUOTE] = S_QUOTE  # a quote opens a pre-token ...
    t[QUOTE, [S_BLANK, S_OTHER, S_QUOTE]] = S_OTHER  # ... unless a blank or a run of symbols takes it
    t[C_STMD, S_QUOTE], t[C_R, S_QUOTE], t[C_V, S_QUOTE], t[C_L, S_QUOTE] = S_DONE1, S_R, S_V, S_L
    t[C_E, [S_R, S_V]] = S_DONE2
    t[C_L, S_L] = S_DONE2
    return t.reshape(-1)


@lru_cache(1)
def starts_table() -> np.ndarray:
    """By previous state * 16 + state: 1 where a pre-token starts, 2 where the next character decides about white space, 3 about a contraction."""
    b = np.ones((16, 16), np.uint8)
    b[[S_LETTER, S_BLANK, S_R, S_V, S_L], S_LETTER] = 0
    b[[S_NUMBER, S_BLANK], S_NUMBER] = 0
    b[[S_OTHER, S_BLANK, S_QUOTE], S_OTHER] = 0
    b[:, [S_DONE1, S_DONE2]] = 0
    b[:, [S_R, S_V, S_L]] = 3
    for white in (S_WHITE, S_BLANK):
        b[[S_WHITE, S_BLANK], white] = 2
    return b.reshape(-1)


def run_states(classes: np.ndarray) -> np.ndarray:
    """The automaton's state after each character, by a blocked scan over transition functions.

    Once a block's function is constant (nearly always after a few characters)
    its value is the state itself, so the rest of the pass needs one row, not twelve.
    """
    t, n = transitions(), len(classes)
    rows = -(-n // BLOCK)
    x = np.full(rows * BLOCK, RESET, np.uint8)
    x[:n] = classes
    x = np.ascontiguousarray(x.reshape(rows, BLOCK).T) * np.uint8(STATES)
    f = np.repeat(np.arange(STATES, dtype=np.uint8)[:, None], rows, 1)
    out = np.empty((BLOCK, rows), np.uint8)
    replay = BLOCK
    for i, row in enumerate(x):  # each block's function
        f = t.take(f + row)
        if len(f) == 1:
            out[i] = f[0]
        elif i % 8 == 7 and (f == f[0]).all():
            f, replay = f[:1], i + 1
    if len(f) == 1:
        f = np.repeat(f, STATES, 0)
    step = 1
    while step < rows:  # inclusive scan over the blocks
        f[:, step:] = _after(f, step)
        step *= 2
    state = np.empty(rows, np.uint8)
    state[0], state[1:] = S_START, f[S_START, :-1]
    for i, row in enumerate(x[:replay]):
        out[i] = state = t.take(state + row)
    return out.T.reshape(-1)[:n]


def _after(f: np.ndarray, step: int) -> np.ndarray:
    """Column b: first the function of column b - step, then that of column b."""
    late = f[:, step:]
    return late[f[:, :-step], np.arange(late.shape[1])]


def boundaries(classes: np.ndarray) -> np.ndarray:
    """Whether a pre-token starts at each character. RESET classes stand for the ends of texts."""
    s = run_states(classes)
    before, after = np.empty_like(s), np.empty_like(s)
    before[0], before[1:] = S_START, s[:-1]
    after[-1], after[:-1] = S_START, s[1:]
    flag = starts_table().take(before * np.uint8(16) + s)
    out = flag == 1
    # The last of several white characters stands apart where a text goes on after it.
    out |= (flag == 2) & (after != S_WHITE) & (after != S_BLANK) & (after != S_START)
    out |= (flag == 3) & (after != S_DONE2)
    out[classes == RESET] = False
    return out


def cut_pieces(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """All texts as UTF-8 with a line feed after each; the first bytes of all pre-tokens and of the line feeds between texts; which of them are such line feeds."""
    joined = "\n".join(texts) + "\n"
    ends = np.cumsum(np.fromiter((len(x) + 1 for x in texts), np.int64, len(texts))) - 1
    try:  # one byte a character
        narrow = joined.encode("latin-1")
        classes = np.frombuffer(bytearray(narrow.translate(class_table()[:256].tobytes())), np.uint8)
    except UnicodeEncodeError:
        classes = class_table().take(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32))
    classes[ends] = RESET
    first = boundaries(classes)
    first[ends] = True
    at = np.flatnonzero(first)
    breaks = np.searchsorted(at, ends)
    data = joined.encode("utf-8", "surrogatepass")
    if len(data) != len(classes):
        at = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)[at]
    return data, at, breaks


def pieces_of(texts: list[str]) -> list[list[tuple[int, bytes]]]:
    """Each text's pre-tokens with their first bytes in it."""
    if not texts:
        return []
    data, at, breaks = cut_pieces(texts)
    stop, out, i = [*at.tolist()[1:], len(data)], [], 0
    for k in breaks.tolist():
        out.append([(int(at[j] - at[i]), data[at[j] : stop[j]]) for j in range(i, k)])
        i = k + 1
    return out


def distinct_slices(data: bytes, at: np.ndarray, known: pa.BinaryArray | None = None) -> tuple[np.ndarray, pa.BinaryArray]:
    """Which of the distinct byte strings each slice of ``data`` is, and those; slices start at ``at`` and end where the next starts.

    The distinct strings of ``known`` come first, in their order. Arrow hashes the slices where they lie.
    """
    offsets = np.append(at, len(data)).astype(np.int32)
    slices = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    if known is None or not len(known):
        found = slices.dictionary_encode()
        return found.indices.to_numpy(), found.dictionary
    found = pa.concat_arrays([known, slices]).dictionary_encode()
    return found.indices.to_numpy()[len(known) :], found.dictionary


def flat_of(strings: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of an array, and where each string starts (one more at the end)."""
    if not len(strings):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64)
    data = strings.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, bounds - bounds[0]


def gathered(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ranges [start, start + size) of ``flat`` one after another, and what stands before each (one more at the end)."""
    before = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=before[1:])
    return flat[np.repeat(start - before[:-1], size) + np.arange(before[-1])], before


class PieceCache:
    """Pre-tokens met before and their ids. Beyond ``entries``, those that the last chunk used stay."""

    def __init__(self, ranks: Ranks, entries: int = CACHE_ENTRIES):
        self.ranks, self.entries = ranks, entries
        self.added = {k: np.array([v], np.uint16) for k, v in ranks.added.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")
        self.known, self.flat, self.before = pa.array([], pa.binary()), np.zeros(0, np.uint16), np.zeros(1, np.int64)

    def coded(self, data: bytes, at: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all slices, none for ``breaks``, and how many stand before each slice (one more at the end)."""
        which, every = distinct_slices(data, at, self.known)
        k = len(self.known)
        if len(every) > k:
            ids, size = self.ranks.merge_all(*flat_of(every.slice(k)))
            self.known, self.flat = every, np.concatenate([self.flat, ids])
            self.before = np.concatenate([self.before, self.before[-1] + np.cumsum(size)])
        start, size = self.before[:-1], np.diff(self.before)
        count = size[which]
        count[breaks] = 0
        out = gathered(self.flat, start[which], count)
        if len(every) > self.entries or self.known.nbytes > 64 * self.entries:
            _, bounds = flat_of(self.known)
            used = np.flatnonzero((np.bincount(which, minlength=len(every)) > 0) & (np.diff(bounds) <= CACHED_BYTES))[: self.entries // 2]
            self.known = self.known.take(pa.array(used))
            self.flat, self.before = gathered(self.flat, start[used], size[used])
        return out


NONE, ROW_BITS = np.int32(1 << 30), 6


class Ranks:
    """Token bytes -> id (also the merge order), and the merging of pieces by it. No merge makes an added token.

    ``whole_first``: a piece that is a token stands for itself, whatever its bytes merge into.
    """

    def __init__(self, ids: dict[bytes, int], added: dict[str, int] | None = None, whole_first: bool = False):
        self.ids, self.added = ids, added or {}
        tokens = [b""] * (max([*ids.values(), *self.added.values()]) + 1)
        if len(tokens) > 1 << 16:
            raise ValueError("ids have 16 bits here")
        for k, v in [*ids.items(), *((k.encode(), v) for k, v in self.added.items())]:
            tokens[v] = k
        self.tokens = pa.array(tokens, pa.binary())
        self.widths = np.array(list(map(len, tokens)), np.int64)
        self.decimal = pa.array([b"%d " % i for i in range(len(tokens))], pa.binary())
        self.byte_id = np.array([ids[bytes([i])] for i in range(256)], np.int32)
        pairs = {(ids[a], ids[b]): v for k, v in ids.items() for i in range(1, len(k)) if (a := k[:i]) in ids and (b := k[i:]) in ids}
        self._hash({a << 16 | b: v for (a, b), v in pairs.items()})
        self.odd: dict[bytes, int] = {}
        if whole_first:  # tokens that their own bytes do not merge into
            numbers = np.array(list(ids.values()))
            got, count = self.merge_all(*flat_of(pa.array(list(ids), pa.binary())))
            whole = np.zeros(len(count), bool)
            whole[count == 1] = got[(np.cumsum(count) - 1)[count == 1]] == numbers[count == 1]
            self.odd = {k: v for (k, v), fine in zip(ids.items(), whole.tolist(), strict=True) if not fine}

    def _hash(self, pairs: dict[int, int]) -> None:
        """An open-addressed table of id pairs that numpy can probe."""
        keys, values = np.fromiter(pairs, np.uint32, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs))
        self.bits = max(4, int(len(keys) * 3).bit_length())
        self.keys, self.values = np.zeros(1 << self.bits, np.uint32), np.full(1 << self.bits, NONE, np.int32)
        at = self._slot(keys)
        while len(keys):
            free = np.flatnonzero(self.values[at] == NONE)
            slot, one = np.unique(at[free], return_index=True)
            one = free[one]
            self.keys[slot], self.values[slot] = keys[one], values[one]
            left = np.ones(len(keys), bool)
            left[one] = False
            keys, values, at = keys[left], values[left], (at[left] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint32(2654435769)) >> np.uint32(32 - self.bits)).astype(np.int64)

    def pair_ids(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The id that each pair merges into, or NONE."""
        keys = (a.astype(np.uint32) << np.uint32(16)) | b.astype(np.uint32)
        at = self._slot(keys)
        out = self.values[at]
        todo = np.flatnonzero((self.keys[at] != keys) & (out != NONE))
        while len(todo):
            at[todo] = (at[todo] + 1) & (len(self.keys) - 1)
            out[todo] = self.values[at[todo]]
            todo = todo[(self.keys[at[todo]] != keys[todo]) & (out[todo] != NONE)]
        return out

    def merge_all(self, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges in every piece, again and again, the leftmost adjacent pair of lowest rank; all pieces advance together.

        ``raw``: the pieces' bytes, one after another, cut at ``bounds``. Returns all ids, and how many each piece has.
        """
        lens = np.diff(bounds)
        done: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int32))]
        for i in np.flatnonzero(lens > LONG).tolist():
            own = self.merge_long(raw[bounds[i] : bounds[i + 1]].tobytes())
            done.append((np.full(len(own), i), own))
        low = 0
        for high in WIDTHS:
            some = np.flatnonzero((lens > low) & (lens <= high))
            if len(some):
                done += self._merge_columns(raw, bounds[some], lens[some], some)
            low = high
        owner, ids = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(owner, kind="stable")
        ids, count = ids[order].astype(np.uint16), np.bincount(owner, minlength=len(lens))
        if self.odd:
            data, text = raw.tobytes(), bounds.tolist()
            for i in np.flatnonzero(lens <= max(map(len, self.odd))).tolist():
                if (whole := self.odd.get(data[text[i] : text[i + 1]])) is not None:
                    at = int(count[:i].sum())
                    ids = np.concatenate([ids[:at], np.array([whole], np.uint16), ids[at + count[i] :]])
                    count[i] = 1
        return ids, count

    def _merge_columns(self, raw: np.ndarray, start: np.ndarray, size: np.ndarray, number: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(numbers of pieces, their ids) of pieces of about one length: a column each, a row for each byte of them.

        A cell's key is the rank of its pair, then the row, so a column's least key is its leftmost pair of lowest rank.
        A round merges that one in every column; cells are linked, none moves.
        """
        rows, n, out = int(size.max()), len(size), []
        inside = np.arange(rows)[:, None] < size
        ids = np.full((rows + 1, n), -1, np.int32)
        ids[:rows][inside] = self.byte_id[raw[(start + np.arange(rows)[:, None])[inside]]]
        key = np.full((rows, n), NONE, np.int32)
        both = inside[1:]
        found = self.pair_ids(ids[: rows - 1][both], ids[1:rows][both])
        key[:-1][both] = np.where(found == NONE, NONE, found << ROW_BITS | np.broadcast_to(np.arange(rows - 1, dtype=np.int32)[:, None], both.shape)[both])
        links = np.arange(rows + 1, dtype=np.int32)[:, None]
        after, before = np.where(links + 1 < size, links + 1, rows).astype(np.int32), np.broadcast_to(links - 1, (rows + 1, n)).copy()
        while True:
            low = key.min(0)
            go = np.flatnonzero(low != NONE)
            if len(go) * 4 < len(low) * 3:
                done = np.flatnonzero(low == NONE)
                left = ids[:, done].T
                full = left >= 0
                out.append((np.repeat(number[done], full.sum(1)), left[full]))
                if not len(go):
                    return out
                number, low = number[go], low[go]
                ids, key, after, before = (x.take(go, 1) for x in (ids, key, after, before))
                n, go = len(number), np.arange(len(number))
            low = low[go]
            row, new = low & (1 << ROW_BITS) - 1, low >> ROW_BITS
            i, k, nx, pv = ids.reshape(-1), key.reshape(-1), after.reshape(-1), before.reshape(-1)
            here = row * n + go
            second = nx[here]
            gone = second * n + go
            third, first = nx[gone], pv[here]
            i[here], i[gone], nx[here] = new, -1, third
            k[gone] = NONE
            beyond = third * n + go
            pv[beyond] = row
            right = i[beyond]
            pair = self.pair_ids(new, np.maximum(right, 0))
            k[here] = np.where((right < 0) | (pair == NONE), NONE, pair << ROW_BITS | row)
            some = np.flatnonzero(first >= 0)
            if len(some):
                first = first[some]
                at = first * n + go[some]
                pair = self.pair_ids(i[at], new[some])
                k[at] = np.where(pair == NONE, NONE, pair << ROW_BITS | first)

    def merge_long(self, piece: bytes) -> np.ndarray:
        """The same for one long piece: a heap over a linked list, n log n."""
        import heapq

        n, get = len(piece), self.ids.get
        parts: list[bytes | None] = [bytes([b]) for b in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, parts[i] + parts[i + 1]) for i in range(n - 1) if (r := get(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, whole = heapq.heappop(heap)
            j = after[i] if parts[i] is not None else n
            if j >= n or parts[i] + parts[j] != whole:
                continue
            parts[i], parts[j] = whole, None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (r := get(parts[a] + parts[b])) is not None:
                    heapq.heappush(heap, (r, a, parts[a] + parts[b]))
        return np.array([get(x) for x in parts if x is not None], np.int32)


def encode_texts(texts: list[str], cache: PieceCache) -> Iterator[np.ndarray]:
    """The ids of each text as uint16."""
    for ids, bounds in encode_chunks(texts, cache):
        for a, b in zip(bounds, bounds[1:], strict=False):
            yield ids[a:b]


def encode_chunks(texts: list[str], cache: PieceCache) -> Iterator[tuple[np.ndarray, list[int]]]:
    """The ids of some texts at a time, one after another, and the bounds of each text's ids."""
    for i, j in chunks(texts, ENCODE_CHARS):
        some = texts[i:j]
        cuts = [len(cache.cut.findall(x)) for x in some] if any(k in x for k in cache.added for x in some) else []
        if not any(cuts):
            data, at, breaks = cut_pieces(some)
            ids, before = cache.coded(data, at, breaks)
            yield ids, [0, *before[breaks].tolist()]
            continue
        split = [cache.cut.split(x) for x in some]  # every second part is an added token
        data, at, breaks = cut_pieces([p for x in split for p in x[::2]])
        ids, before = cache.coded(data, at, breaks)
        bounds, out, k, last, total = [0], [], 0, 0, 0
        stops = before[breaks].tolist()
        for parts in split:
            for n, p in enumerate(parts):
                if n % 2:
                    out.append(cache.added[p])
                else:
                    out.append(ids[last : stops[k]])
                    last, k = stops[k], k + 1
                total += len(out[-1])
            bounds.append(total)
        yield np.concatenate(out), bounds


@lru_cache(2)
def ranks(path: str) -> Ranks:
    """From a rank file (base64 token and rank a line) or a byte-level BPE's JSON file.

    Both must number tokens in merge order, as these vocabularies do.
    """
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        vocab, extra = whole["model"]["vocab"], whole.get("added_tokens") or []
        if any(x.get(k) for x in extra for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens that look at their surroundings are not supported")
        added = {x["content"]: x["id"] for x in extra}
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        return Ranks({bytes(byte[c] for c in k): v for k, v in vocab.items() if all(c in byte for c in k) and k not in added}, added)
    with open(path, "rb") as f:
        return Ranks({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, whole_first=True)


@lru_cache(2)
def rank_cache(path: str) -> PieceCache:
    cache = PieceCache(ranks(path))
    trim()  # what reading the vocabulary has left
    return cache


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>, starts array<int>: ids, and each id's first byte in its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, cache = ranks(vocabulary), rank_cache(vocabulary)
        for keys, texts in text_batches(batches, ENCODE_CHARS, ENCODE_ROWS):
            for i, ids, bounds, places, ends in _placed(texts, r, cache):
                cut = pa.array(bounds, pa.int32())
                own = np.repeat(np.append(0, ends[:-1]), np.diff(bounds))
                lists = [pa.ListArray.from_arrays(cut, pa.array(x.astype(np.int32))) for x in (ids, places - own)]
                yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + len(bounds) - 1], pa.int64()), *lists], ["doc_id", "ids", "starts"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, starts array<int>")


def _placed(texts: list[str | None], r: Ranks, cache: PieceCache) -> Iterator[tuple[int, np.ndarray, list[int], np.ndarray, np.ndarray]]:
    """Some texts at a time: the first one's number, ids, bounds of each text's ids, each id's first byte in all these texts, and where each text ends."""
    i = 0
    for ids, bounds in encode_chunks([x or "" for x in texts], cache):
        stops = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(r.widths[ids], out=stops[1:])
        yield i, ids, bounds, stops[:-1], stops[bounds[1:]]
        i += len(bounds) - 1


def decode(encoded: DataFrame, vocabulary: str, start: int = 0, stop: int | None = None) -> DataFrame:
    """doc_id, content binary: bytes [start, stop) of what ``ids`` stand for (null ids: empty).

    The retained ``starts`` lead to the ids that cover the range; no other id is read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = ranks(vocabulary)
        for b in batches:
            out = []
            for i in range(b.num_rows):
                if not b.column(1)[i].is_valid:
                    out.append(b"")
                    continue
                ids, starts = (np.asarray(c[i].values) for c in (b.column(1), b.column(2)))
                first = max(int(np.searchsorted(starts, start, "right")) - 1, 0)
                last = len(ids) if stop is None else int(np.searchsorted(starts, stop, "left"))
                raw, _ = flat_of(r.tokens.take(pa.array(ids[first:last])))
                at = int(starts[first]) if len(starts) else 0
                out.append(raw[max(start - at, 0) : None if stop is None else max(stop - at, 0)].tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["doc_id", "content"])

    return encoded.select("doc_id", "ids", "starts").mapInArrow(run, "doc_id long, content binary")


def digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 in one pass, so that ids never leave the worker; decoded texts are cut at the retained offsets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, cache = ranks(vocabulary), rank_cache(vocabulary)
        for keys, texts in text_batches(batches, ENCODE_CHARS, ENCODE_ROWS):
            n, a, b = [], [], []
            for _, ids, bounds, _, ends in _placed(texts, r, cache):
                n += np.diff(bounds).tolist()
                listed, at = flat_of(r.decimal.take(pa.array(ids)))
                a += [_sha256(listed[x : max(x, y - 1)]) for x, y in zip(at[bounds[:-1]].tolist(), at[bounds[1:]].tolist(), strict=True)]
                raw, _ = flat_of(r.tokens.take(pa.array(ids)))
                ends = ends.tolist()
                b += [_sha256(raw[x:y]) for x, y in zip([0, *ends], ends, strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _sha256(data: np.ndarray) -> str:
    return hashlib.sha256(np.ascontiguousarray(data)).hexdigest()


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
