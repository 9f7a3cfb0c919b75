"""Quality rules by tokeniser fertility (operator 1).

Two public vocabularies read every text. The byte-level one gives characters
per token, tokens per word and the entropy of its token ids, by Shannon and by
collision (which a few dominant tokens pull down far more); the one with byte
fallback gives its own characters per token and the share of fallback bytes. The
language tag, or else the script most letters belong to, picks the band that
the figures must lie in; a text whose script has no band, or that has no
letter, gets the ``other`` band.

Defined results: a null or empty text has all counts 0 and fails the base
rules; figures of a text without tokens are null; texts of any length are
read whole; repeated rows stay repeated; further columns are ignored by
``measure`` and kept by ``keep``.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weftline.llm import bpe
from weftline.llm.bpe import distinct_slices, flat_of
from weftline.llm.common import as_bytes, table, text_batches

SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\v\f\r"


@dataclass(frozen=True)
class Band:
    """What a text's figures must satisfy; entropies are those of its token ids, in bits."""

    min_chars_per_token: float
    max_chars_per_token: float
    max_tokens_per_word: float
    max_byte_share: float
    min_entropy: float
    min_collision_entropy: float


#: By language tag (lower case) where one is given and known, else by script. Wide on purpose: prose lies inside,
#: runs of symbols, tables of cell marks, hex dumps and loops do not. The four languages' bands lie outside the 0.1 and
#: 99.9 per cent quantiles (``band_quantiles``) of documents labelled good in the test tables; those of scripts
#: without such documents are set by hand from what these vocabularies make of a character of theirs.
BANDS: dict[str, Band] = {
    "en": Band(1.75, 8.0, 3.5, 0.06, 4.5, 4.95),
    "de": Band(1.75, 8.0, 3.8, 0.06, 4.5, 4.95),
    "fr": Band(1.70, 8.0, 3.9, 0.06, 4.5, 4.85),
    "es": Band(1.65, 8.0, 4.0, 0.06, 4.5, 4.60),
    "LATIN": Band(1.60, 8.0, 4.0, 0.10, 4.3, 4.55),
    "GREEK": Band(0.45, 6.0, 16.0, 0.40, 4.0, 4.0),
    "CYRILLIC": Band(0.45, 6.0, 14.0, 0.15, 4.0, 4.0),
    "HEBREW": Band(0.40, 6.0, 16.0, 0.60, 3.5, 3.5),
    "ARABIC": Band(0.40, 6.0, 16.0, 0.60, 3.5, 3.5),
    "other": Band(0.20, 8.0, float("inf"), 1.00, 3.0, 3.0),
}
SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    "band string, chars_per_token double, chars_per_piece double, tokens_per_word double, byte_share double, token_entropy double, collision_entropy double"
)


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each key, which of the distinct ones it is; how often each of those occurs, in order of first occurrence."""
    which = pa.array(keys).dictionary_encode().indices.to_numpy()
    return which, np.bincount(which)


def base_counts(texts: list[str]) -> np.ndarray:
    """A row for each text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    data, starts = as_bytes(texts)
    n, raw = len(texts), data.tobytes()
    kind = _byte_kinds()[data]
    kind[starts[1:] - 1] = BREAK
    ends = starts[1:]

    def per_text(flag: np.ndarray) -> np.ndarray:
        total = np.zeros(len(flag) + 1, np.int64)
        np.cumsum(flag, out=total[1:])
        return total[ends] - total[starts[:-1]]

    out = np.zeros((n, 5), np.int64)
    out[:, 1] = per_text((kind == PLAIN) | (kind == SYMBOL))
    out[:, 2] = per_text(kind == SYMBOL)
    blank = kind >= BLANK
    flips = np.flatnonzero(np.diff(blank, prepend=True))  # a word, what is between words, a word ...
    first = flips[::2]
    at = np.searchsorted(first, starts)
    out[:, 0] = np.diff(at)
    if len(first) == 0:
        return out
    which, _ = distinct_slices(raw, np.append(0, flips) if flips[0] else flips)
    word = which[(1 if flips[0] else 0) :: 2].astype(np.int64)
    owner = np.repeat(np.arange(n), out[:, 0])
    if len(word) > 2:
        k = int(word.max()) + 1
        window = _counted(word[:-2] * k + word[1:-1])[0].astype(np.int64) * k + word[2:]
        inside = owner[2:] == owner[:-2]
        # Equal windows of one text: of the distinct windows, then of (text, window).
        which, _ = _counted(window[inside])
        which, count = _counted(owner[:-2][inside] * len(window) + which)
        again = np.zeros(len(window), bool)
        again[inside] = count[which] > 1
        cover = np.zeros(len(word), bool)
        for i in range(3):
            cover[i : i + len(again)] |= again
        out[:, 4] = np.bincount(owner[cover], minlength=n)
    feeds = np.flatnonzero((data == 10) | (kind == BREAK)) + 1
    begin = np.append(0, feeds[:-1])
    full = np.searchsorted(first, feeds) > np.searchsorted(first, begin)  # a word starts in a line that holds one
    which, _ = distinct_slices(_with_feeds(raw, starts), begin)
    owner = np.searchsorted(starts, begin, "right") - 1
    owner, which = owner[full], which[full].astype(np.int64)
    _, count = _counted(owner * (len(begin) + 1) + which)
    distinct = np.bincount(np.unique(owner * (len(begin) + 1) + which) // (len(begin) + 1), minlength=n)
    out[:, 3] = np.bincount(owner, minlength=n) - distinct
    return out


def _with_feeds(raw: bytes, starts: np.ndarray) -> bytes:
    """The last line of a text ends with a line feed too, so that it can equal the others."""
    out = np.frombuffer(raw, np.uint8).copy()
    out[starts[1:] - 1] = 10
    return out.tobytes()


PLAIN, SYMBOL, INNER, BLANK, BREAK = range(5)


@lru_cache(1)
def _byte_kinds() -> np.ndarray:
    """First bytes of characters, symbols, other bytes of characters, blanks."""
    out = np.zeros(256, np.uint8)
    out[128:192] = INNER
    out[list(SYMBOLS)], out[list(BLANKS)] = SYMBOL, BLANK
    return out


@lru_cache(1)
def _scripts() -> dict[str, str]:
    return {}


def script_of(text: str) -> str | None:
    """The script of most letters; None without a letter. Ties go to the script met first."""
    letters = text.encode("ascii", "ignore")
    latin = sum(map(letters.count, b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")) if letters else 0
    if latin * 2 > len(text):
        return "LATIN"
    known, count = _scripts(), {}
    for c in set(text):
        if c.isalpha():
            s = known.get(c)
            if s is None:
                s = known[c] = unicodedata.name(c, "other").split(" ")[0].removesuffix("-COMPATIBILITY")
            count[s] = count.get(s, 0) + text.count(c)
    return max(count, key=count.get) if count else None


class Pieces:
    """How many pieces, and how many of them bytes, a sentencepiece model with byte fallback makes of texts.

    The model puts a blank before a text and writes blanks as a mark. No piece holds a mark after another character
    or a line feed, so no piece reaches across the start of a run of blanks or feeds, and texts can be counted by
    their distinct segments between such starts.
    """

    def __init__(self, path: str, entries: int = 150_000):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        if any(MARK in x.lstrip(MARK) or "\n" in x for x in names):
            raise ValueError("pieces of this model reach across words")
        self.is_byte = np.array([self.sp.is_byte(i) for i in range(len(names))])
        self.entries, self.known, self.counts = entries, pa.array([], pa.binary()), np.zeros((0, 2), np.int64)

    def _count(self, segments: list[bytes]) -> np.ndarray:
        ids = self.sp.encode([x.decode("utf-8", "replace") for x in segments])
        flat = np.fromiter((i for x in ids for i in x), np.int64)
        before = np.zeros(len(flat) + 1, np.int64)
        np.cumsum(self.is_byte[flat], out=before[1:])
        stop = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))
        return np.stack([np.diff(stop, prepend=0), np.diff(before[stop], prepend=0)], 1)

    def __call__(self, texts: list[str]) -> np.ndarray:
        """A row for each text: pieces, bytes among them."""
        data, starts = as_bytes([x.replace(MARK, " ") for x in texts])  # the model takes one for the other
        ends = starts[1:] - 1
        before = np.append(np.uint8(0), data[:-1])
        head = np.zeros(len(data), bool)
        head[starts[:-1]] = True
        inner = ~head
        mark = inner & (data == 32) & (before != 32)  # what the model would put before a text itself
        mark[ends] = False
        feed = inner & (data == 10) & (before != 10) & (before != 32)
        feed[ends] = False
        cut = head | mark | feed
        cut[ends] = True
        cut[1:] |= mark[:-1]
        at = np.flatnonzero(cut)
        skip = mark[at] | np.isin(at, ends)
        which, every = distinct_slices(data.tobytes(), at, self.known)
        k = len(self.known)
        if len(every) > k:
            self.known, self.counts = every, np.concatenate([self.counts, self._count(every.slice(k).to_pylist())])
        rows = self.counts[which]
        rows[skip] = 0
        owner = np.searchsorted(starts, at, "right") - 1
        out = np.stack([np.bincount(owner, rows[:, c], len(texts)) for c in (0, 1)], 1).astype(np.int64)
        out[:, 0] -= np.bincount(owner[feed[at] & ~mark[np.maximum(at - 1, 0)]], minlength=len(texts))  # the blank before it is not in the text
        out[:, 0] += (ends > starts[:-1]) & mark[np.maximum(ends - 1, 0)]  # a last blank is a piece
        if len(every) > self.entries or self.known.nbytes > 64 * self.entries:
            used = np.flatnonzero(np.bincount(which, minlength=len(every)) > 0)
            _, bounds = flat_of(self.known)
            used = used[np.diff(bounds)[used] <= 48][: self.entries // 2]
            self.known, self.counts = self.known.take(pa.array(used)), self.counts[used]
        return out


MARK = "\u2581"
#: Characters that ``keep`` measures at once.
KEEP_CHARS = 500_000


@lru_cache(1)
def _fallback(path: str) -> Pieces:
    return Pieces(path)


def entropies(ids: np.ndarray, bounds: list[int]) -> np.ndarray:
    """A row for each text: Shannon and collision entropy of its ids, in bits (0 without ids)."""
    size = np.diff(bounds)
    owner = np.repeat(np.arange(len(size)), size)
    which, count = _counted((owner << 16) | ids)
    once = np.zeros(len(count), np.int64)
    once[which] = owner
    n = np.maximum(size, 1).astype(float)
    share = count / n[once]
    shannon = -np.bincount(once, share * np.log2(share), len(size))
    collision = -np.log2(np.maximum(np.bincount(once, share * share, len(size)), 1 / n**2))
    return np.abs(np.stack([shannon, np.where(size, collision, 0)], 1))


def within(band: Band, per_token: float, per_piece: float, per_word: float, byte_share: float, entropy: float, collision: float) -> bool:
    low, high = band.min_chars_per_token, band.max_chars_per_token
    return low <= per_token <= high and low <= per_piece <= high and per_word <= band.max_tokens_per_word and byte_share <= band.max_byte_share and entropy >= band.min_entropy and collision >= band.min_collision_entropy


def _measured(texts: list[str], langs: list[str | None], chosen: dict[str, Band], cache: bpe.PieceCache, pieces: Pieces, min_words: int, max_repeat_percent: int) -> Iterator[tuple]:
    """SCHEMA without the id, for each text."""
    at = 0
    for ids, bounds in bpe.encode_chunks(texts, cache):
        some = texts[at : at + len(bounds) - 1]
        figures = zip(base_counts(some).tolist(), np.diff(bounds).tolist(), pieces(some).tolist(), entropies(ids, bounds).tolist(), strict=True)
        for text, (base, n, (n_pieces, n_bytes), (entropy, collision)) in zip(some, figures, strict=True):
            failed = base[0] < min_words or 100 * base[4] > max_repeat_percent * base[0]
            band = (langs[at] or "").lower()
            if band not in chosen:
                band = script_of(text)
            band = band if band in chosen else "other"
            found, fine = (None,) * 6, False
            if n:
                whole = max(n_pieces, 1)
                found = (len(text) / n, len(text) / whole, n / max(base[0], 1), n_bytes / whole, entropy, collision)
                fine = within(chosen[band], *found)
            yield (*base, failed, fine and not failed, band, *found)
            at += 1


def _kinds(schema: str) -> tuple[list[str], list[pa.DataType]]:
    types = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "double": pa.float64()}
    names, kinds = zip(*(x.split() for x in schema.split(", ")), strict=True)
    return list(names), [types[k] for k in kinds]


def measure(
    docs: DataFrame, byte_vocabulary: str, piece_model: str, bands: dict[str, Band] | None = None, min_words: int = 50, max_repeat_percent: int = 50, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang"
) -> DataFrame:
    """A row of figures and verdicts for each document (SCHEMA)."""
    chosen = dict(bands or BANDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools, (names, kinds) = (bpe.rank_cache(byte_vocabulary), _fallback(piece_model)), _kinds(SCHEMA)
        for whole in batches:
            langs, at = whole.column(2).to_pylist(), 0
            for keys, texts in text_batches(iter([whole]), bpe.ENCODE_CHARS, bpe.ENCODE_ROWS):
                rows = _measured([x or "" for x in texts], langs[at : at + len(texts)], chosen, *tools, min_words, max_repeat_percent)
                at += len(texts)
                columns = zip(*((k, *r) for k, r in zip(keys, rows, strict=True)), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), _lang(docs, lang_col).alias("lang")).mapInArrow(run, SCHEMA)


def _lang(docs: DataFrame, lang_col: str | None) -> Column:
    return F.col(lang_col).cast("string") if lang_col and lang_col in docs.columns else F.lit(None).cast("string")


def keep(
    docs: DataFrame, byte_vocabulary: str, piece_model: str, bands: dict[str, Band] | None = None, min_words: int = 50, max_repeat_percent: int = 50, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang"
) -> DataFrame:
    """The rows of ``docs`` whose document passes, with all their columns, in one pass; a null id never passes.

    Texts travel to the workers once, inside their rows, and are measured in smaller pieces than elsewhere: a pipeline's
    workers share their memory with the stages that follow.
    """
    chosen = dict(bands or BANDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = bpe.rank_cache(byte_vocabulary), _fallback(piece_model)
        for whole in batches:
            langs, at = whole.column(1).to_pylist(), 0
            texts_of = pa.RecordBatch.from_arrays([whole.column(0), whole.column(2).field(text_col).cast(pa.string())], ["id", "text"])
            for keys, texts in text_batches(iter([texts_of]), KEEP_CHARS, bpe.ENCODE_ROWS):
                rows = _measured([x or "" for x in texts], langs[at : at + len(texts)], chosen, *tools, min_words, max_repeat_percent)
                good = [k is not None and r[6] for k, r in zip(keys, rows, strict=True)]
                part = whole.slice(at, len(texts))
                at += len(texts)
                yield pa.RecordBatch.from_arrays([part.column(2).filter(pa.array(good, pa.bool_()))], ["row"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), _lang(docs, lang_col).alias("lang"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    return rows.mapInArrow(run, StructType([rows.schema["row"]])).select(*(F.col(f"row.`{c}`") for c in docs.columns))


def band_quantiles(measured: DataFrame, quantiles: tuple[float, ...] = (0.001, 0.999)) -> DataFrame:
    """band, n and the quantiles of each figure over the rows of ``measure``: where bands for such documents should lie."""
    figures = ["chars_per_token", "chars_per_piece", "tokens_per_word", "byte_share", "token_entropy", "collision_entropy"]
    return measured.groupBy("band").agg(F.count(F.lit(1)).alias("n"), *(F.percentile_approx(c, list(quantiles), 10_000).alias(c) for c in figures))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as p

    return measure(table(spark, sf_dir, "documents"), p.path("byte_bpe_50k.tiktoken"), p.path("piece_bpe_32k.model"))
