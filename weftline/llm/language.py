"""Language identification as a mixture (operator 10).

Training counts character trigrams (letters and word edges, lower case) of the
labelled rows, per language, in a fixed number of hash buckets; smoothed, they
are the likelihoods. For each text, expectation-maximisation estimates the
share of every language, until no share moves by more than TOLERANCE; nested
sets of its strongest languages, up to all that were learned, are refitted and
the set of greatest penalised likelihood is kept. The prediction is the
set's largest share, and the score is that share.

Defined results: null texts and texts without a letter get ``und`` and score
0; without any labelled row everything is ``und``; ties go to the language
first in alphabetical order; repeated rows stay repeated; texts of any length
are read whole; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import bpe
from weftline.llm.common import id_text, table, text_batches

#: Hash buckets of trigrams: what the model costs, whatever the corpus.
BUCKETS = 1 << 14
SMOOTHING = 0.5
#: EM ends for a text when a round moves none of its shares by more.
TOLERANCE = 1e-4


@lru_cache(1)
def _letters() -> np.ndarray:
    """Lower-case code point of each letter, 0 for all else."""
    table_ = bpe.class_table()
    letter = (table_ == bpe.LETTER) | (table_ >= bpe.C_STMD) & (table_ < bpe.RESET)
    out = np.zeros(len(table_), np.uint32)
    for i in np.flatnonzero(letter).tolist():
        low = chr(i).lower()
        out[i] = ord(low) if len(low) == 1 else i
    return out


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every trigram around a letter, and the text that each belongs to."""
    joined = " " + " ".join(texts) + " "
    c = _letters().take(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32))
    mid = np.flatnonzero(c[1:-1]) + 1
    h = (c[mid - 1] * np.uint32(0x9E3779B1)) ^ (c[mid] * np.uint32(0x85EBCA77)) ^ (c[mid + 1] * np.uint32(0xC2B2AE3D))
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    ends = np.cumsum([len(x) + 1 for x in texts])
    return (h >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int64), np.searchsorted(ends, mid - 1, "right")


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, bucket, n: trigram counts of all rows that have a language, at most BUCKETS rows a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            langs = iter(b.column(2).to_pylist())
            for keys, texts in text_batches(iter([b])):
                own = [next(langs) for _ in keys]
                names = sorted(set(own))
                index = np.array([names.index(x) for x in own])
                h, doc = trigrams([x or "" for x in texts])
                count = np.bincount(index[doc] * BUCKETS + h, minlength=len(names) * BUCKETS).reshape(-1, BUCKETS)
                for name, row in zip(names, count, strict=True):
                    total[name] = total.get(name, 0) + row
        for name, row in total.items():
            at = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at), pa.array(row[at])], ["lang", "bucket", "n"])

    rows = labelled.where(F.col(lang_col).isNotNull()).select(F.col(id_col).cast("long"), F.col(text_col).cast("string"), F.col(lang_col).cast("string"))
    return rows.mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def likelihoods(counts: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order, and a (BUCKETS, languages) matrix of probabilities; its size is fixed by both."""
    rows = counts.toPandas()
    langs = sorted(rows.lang.unique())
    m = np.full((BUCKETS, len(langs)), SMOOTHING)
    m[rows.bucket, [langs.index(x) for x in rows.lang]] += rows.n
    return langs, m / m.sum(0)


def _fit(p: np.ndarray, count: np.ndarray, first: np.ndarray, size: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares and log-likelihood of each text over the languages it may use."""
    w = allowed / allowed.sum(1, keepdims=True)
    total = np.add.reduceat(count, first)
    open_, q, c, n = np.arange(len(w)), p, count, size
    while True:
        old = w[open_]
        r = np.repeat(old, n, 0) * q
        r *= (c / r.sum(1))[:, None]
        w[open_] = new = np.add.reduceat(r, np.cumsum(n) - n, 0) / total[open_][:, None]
        moving = np.abs(new - old).max(1) > TOLERANCE
        if not moving.any():
            break
        if not moving.all():
            rows = np.repeat(moving, n)
            open_, q, c, n = open_[moving], q[rows], c[rows], n[moving]
    z = np.maximum((np.repeat(w, size, 0) * p).sum(1), 1e-300)
    return w, np.add.reduceat(count * np.log(z), first)


def mixtures(texts: list[str], p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(texts, languages) shares of each text's chosen set, and its trigram count; zeros without a letter."""
    out, n = np.zeros((len(texts), p.shape[1])), np.zeros(len(texts), np.int64)
    h, doc = trigrams(texts)
    if not len(h) or not p.shape[1]:
        return out, n
    key, count = np.unique(doc * BUCKETS + h, return_counts=True)
    doc, h = np.divmod(key, BUCKETS)
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    size = np.diff(first, append=len(doc))
    have, rows = doc[first], p[h]
    count = count.astype(float)
    total = np.add.reduceat(count, first)
    w, _ = _fit(rows, count, first, size, np.ones((len(have), p.shape[1])))
    order = np.argsort(np.argsort(-w, 1, kind="stable"), 1, kind="stable")
    best, chosen = np.full(len(have), -np.inf), w
    for k in range(1, p.shape[1] + 1):
        if k == 1:
            shares = (order == 0).astype(float)
            like = np.add.reduceat(count * np.log((np.repeat(shares, size, 0) * rows).sum(1)), first)
        else:
            shares, like = _fit(rows, count, first, size, (order < k).astype(float))
        value = like - 0.5 * k * np.log(total + 1) - 2.0 * k  # a set pays for each of its languages
        better = value > best
        best, chosen = np.where(better, value, best), np.where(better[:, None], shares, chosen)
    out[have], n[have] = chosen, total.astype(np.int64)
    return out, n


def identify(docs: DataFrame, langs: list[str], p: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, languages array<struct<lang,share>> (the chosen set, largest first)."""
    spec = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
    shared = docs.sparkSession.sparkContext.broadcast((langs, p))  # languages x BUCKETS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, p = shared.value
        for keys, texts in text_batches(batches):
            shares, n = mixtures([x or "" for x in texts], p)
            top = shares.argmax(1) if len(langs) else n
            names = [langs[i] if k else "und" for i, k in zip(top, n, strict=True)]
            score = [float(s.max()) if k else 0.0 for s, k in zip(shares, n, strict=True)]
            sets = [[{"lang": langs[i], "share": float(s[i])} for i in np.argsort(-s, kind="stable") if s[i] > 0] for s in shares]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(names), pa.array(score, pa.float64()), pa.array(sets, spec)], ["doc_id", "lang_pred", "score", "languages"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, lang_pred string, score double, languages array<struct<lang:string,share:double>>")


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    langs, p = likelihoods(train(docs.where(~held_out() & F.col("doc_id").isNotNull())))
    return identify(docs, langs, p).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "languages")
