"""How the sources of a language differ in their words (operator 13).

Terms are runs of ASCII letters and non-ASCII characters. A language keeps the
terms of at least ``least_docs`` of its documents. Every source's and every
language's term shares are smoothed integers, and shares are compared by
``floor((p - q) ** 2 / q)``.

Terms are encoded as integers twice. Inside a task, the distinct terms of many
documents form a sorted array; each occurrence becomes a position in it, and
``bincount`` counts per source. Over the corpus, the kept terms of all languages
are range-partitioned in UTF-8 order and numbered in chunks of ``chunk`` terms.
A (language, chunk) meets all sources of its language: its counts become dense
vectors, one a source, found by ``searchsorted`` in the sorted sources. All
pairs of sources are summed over a chunk at once, zero counts included, and the
best terms of each source are taken by value and id, since ids rise with UTF-8
order. Only chunk sums and the best terms of chunks leave a task.

Nothing grows in one task: a chunk holds ``chunk`` x sources numbers. The result
has a row for each pair of sources, so that the list of sources is smaller than
the result.

Defined results: null text, language and source count as ''; groups without
terms have pairs, and a language without kept terms has pairs of value 0;
repeated rows and rows with equal ids are documents of their own; only A-Z are
lower-cased; a text of any length is read whole; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.common import as_bytes, chunks, null_safe, spool, table, trim

LEAST_DOCS = 3
BEST_TERMS = 200
#: Terms of a chunk.
CHUNK = 1024
#: Characters whose terms are counted at once.
COUNT_CHARS = 2_000_000
ONE = 1_000_000_000


def terms_of(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """All terms in order as an array of binaries, and the text of each."""
    data, starts = as_bytes(texts)
    data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    inside = ((data >= 97) & (data <= 122)) | (data >= 128)
    first = np.flatnonzero(inside & ~np.append(False, inside[:-1]))
    end = np.flatnonzero(~inside & np.append(False, inside[:-1]))
    offsets = np.zeros(len(first) + 1, np.int32)
    np.cumsum(end - first, out=offsets[1:])
    terms = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])])
    return terms, np.searchsorted(starts, first, "right") - 1


def encoded(terms: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The distinct terms in byte order, and the place of each term among them."""
    coded = terms.dictionary_encode()
    order = np.asarray(coded.dictionary.cast(pa.binary()).argsort() if hasattr(coded.dictionary, "argsort") else pa.compute.sort_indices(coded.dictionary))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return coded.dictionary.take(pa.array(order)), place[np.asarray(coded.indices)]


def counts(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """lang, source, term, docs, n; a group also has a row of the empty term, which is no term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, langs, sources = (c.to_pylist() for c in b.columns)
            for i, j in chunks(texts, COUNT_CHARS):
                keys = list(zip(langs[i:j], sources[i:j], strict=True))
                groups = sorted(set(keys))
                at = {k: g for g, k in enumerate(groups)}
                group_of = np.array([at[k] for k in keys], np.int64)
                terms, text_of = terms_of(texts[i:j])
                distinct, ids = encoded(terms)
                width = len(distinct)
                n = np.bincount(group_of[text_of] * width + ids, minlength=len(groups) * width)
                pairs = np.unique(text_of * np.int64(max(width, 1)) + ids)
                docs_ = np.bincount(group_of[pairs // max(width, 1)] * width + pairs % max(width, 1), minlength=len(groups) * width)
                held = np.flatnonzero(n)
                g = np.concatenate([held // max(width, 1), np.arange(len(groups))])
                words = pa.concat_arrays([distinct.take(pa.array(held % max(width, 1))), pa.array([b""] * len(groups), pa.binary())]).cast(pa.string())
                zero = np.zeros(len(groups), np.int64)
                side = lambda k: pa.array([x[k] for x in groups], pa.string()).take(pa.array(g))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([side(0), side(1), words, pa.array(np.concatenate([docs_[held], zero])), pa.array(np.concatenate([n[held], zero]))], ["lang", "source", "term", "docs", "n"])
        trim()

    read = docs.select(null_safe(text_col).alias("text"), null_safe(lang_col).alias("lang"), null_safe(source_col).alias("source"))
    found = read.mapInArrow(run, "lang string, source string, term string, docs long, n long")
    return found.groupBy("lang", "source", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))


def dictionary(kept: DataFrame, chunk: int) -> DataFrame:
    """kept (lang, term, total) with part and id: chunks of ``chunk`` terms of one language; parts, and ids in them, rise with UTF-8 order."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done, base = None, 0, 0
        for b in batches:
            part, ids = [], []
            for lang, pid in zip(b.column(0).to_pylist(), b.column(3).to_pylist(), strict=True):
                if lang != now or done == chunk:
                    base, now, done = base + (now is not None), lang, 0
                part.append((pid << 32) + base)
                ids.append(done)
                done += 1
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(part, pa.int64()), pa.array(ids, pa.int32())], ["lang", "term", "total", "part", "id"])

    ordered = kept.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")
    placed = ordered.select("lang", "term", "total", F.spark_partition_id().cast("long").alias("pid"))
    return placed.mapInArrow(number, "lang string, term string, total long, part long, id int")


def shares(count: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(10 ** 9 (count + 1) / total), a thousandth at a time so that no product overflows."""
    left, out = count + 1, np.zeros_like(count)
    for _ in range(3):
        left = left * 1000
        out = out * 1000 + left // total
        left %= total
    return out + 1


def compared(dealt: DataFrame, best: int) -> DataFrame:
    """lang, source, part, item, value: sums over a chunk for each pair, and the best terms of a chunk.

    ``dealt`` holds lang, part, role, source, term, id, n, total, kept: for each (lang, part) and in this order, a row
    for each source (role 0: n the source's total, total the language's, kept terms) and one for each count (role 1: n
    of the term there, total of the term).
    """

    def finish(lang: str, heads: list[tuple], cells: list[pa.RecordBatch]) -> pa.RecordBatch:
        sources = [h[0] for h in heads]
        raw = np.array([s.encode() for s in sources], object)
        kept = heads[0][3]
        width = 1 + max(int(np.asarray(c.column("id")).max()) for c in cells)
        dense, totals, words = np.zeros((len(sources), width), np.int64), np.zeros(width, np.int64), np.empty(width, object)
        for c in cells:
            ids, named = np.asarray(c.column("id")), c.column("source").dictionary_encode()
            row = np.searchsorted(raw, np.array([s.encode() for s in named.dictionary.to_pylist()], object))
            dense[row[np.asarray(named.indices)], ids] = np.asarray(c.column("n"))
            totals[ids] = np.asarray(c.column("total"))
            some, first = np.unique(ids, return_index=True)
            words[some] = c.column("term").take(pa.array(first)).to_pylist()
        p = np.stack([shares(row, h[1] + kept) for row, h in zip(dense, heads, strict=True)])
        q = shares(totals, heads[0][2] + kept)
        out: list[tuple[str, str, str, int]] = []
        for a, own in enumerate(p):
            away = ((own - p) ** 2 // p).sum(1).tolist()
            out += [(sources[a], "pair", sources[b], v) for b, v in enumerate(away) if b != a]
            at = np.flatnonzero((dense[a] > 0) & (own > q))
            value = (own[at] - q[at]) ** 2 // q[at]
            first = np.lexsort((at, -value))[:best]
            out += zip([sources[a]] * len(first), ["term"] * len(first), words[at[first]].tolist(), value[first].tolist(), strict=True)
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(out), pa.string()), *(pa.array([x[k] for x in out], pa.string()) for k in range(3)), pa.array([x[3] for x in out], pa.int64())], ["lang", "source", "part", "item", "value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple[str, int] | None = None
        heads: list[tuple] = []
        cells: list[pa.RecordBatch] = []
        for b in batches:
            langs, parts, roles = np.asarray(b.column(0).dictionary_encode().indices), np.asarray(b.column(1)), np.asarray(b.column(2))
            cut = np.flatnonzero((np.diff(parts) != 0) | (np.diff(langs) != 0) | (np.diff(roles) != 0)) + 1
            for at, until in zip([0, *cut.tolist()], [*cut.tolist(), b.num_rows], strict=True):
                if at == until:
                    continue
                here = (b.column(0)[at].as_py(), int(parts[at]))
                if here != now:
                    if now and cells:
                        yield finish(now[0], heads, cells)
                    now, heads, cells = here, [], []
                some = b.slice(at, until - at)
                if roles[at] == 0:
                    heads += zip(*(some.column(c).to_pylist() for c in ("source", "n", "total", "kept")), strict=True)
                else:
                    cells.append(some)
        if now and cells:
            yield finish(now[0], heads, cells)

    return dealt.mapInArrow(run, "lang string, source string, part string, item string, value long")


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, best: int = BEST_TERMS, chunk: int = CHUNK, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank."""
    found = spool(counts(docs, text_col, lang_col, source_col), "terms")
    real = found.where("term <> ''")
    kept = real.groupBy("lang", "term").agg(F.sum("docs").alias("in_docs"), F.sum("n").alias("total")).where(F.col("in_docs") >= least_docs).drop("in_docs")
    ids = spool(dictionary(kept, chunk), "dictionary")
    coded = ids.select(F.col("lang").alias("l"), F.col("term").alias("t"), "total", "part", "id")
    cells = spool(real.join(coded, (real["lang"] == coded["l"]) & (real["term"] == coded["t"])).select("lang", "part", "source", "term", "id", "n", "total"), "cells")
    # One row for each source, and for each language.
    sums = cells.groupBy(F.col("lang").alias("l"), F.col("source").alias("s")).agg(F.sum("n").alias("held"))
    wide = ids.groupBy(F.col("lang").alias("of")).agg(F.count(F.lit(1)).alias("kept"), F.sum("total").alias("whole"))
    sources = found.where("term = ''").select("lang", "source")
    sources = sources.join(sums, (F.col("lang") == F.col("l")) & (F.col("source") == F.col("s")), "left").join(wide, F.col("lang") == F.col("of"), "left")
    sources = spool(sources.select("lang", "source", F.coalesce("held", F.lit(0)).alias("held"), F.coalesce("whole", F.lit(0)).alias("whole"), F.coalesce("kept", F.lit(0)).alias("kept")), "sources")
    parts = ids.select(F.col("lang").alias("of"), "part").distinct()
    heads = sources.join(parts, F.col("lang") == F.col("of")).select("lang", "part", F.lit(0).alias("role"), "source", F.lit(None).cast("string").alias("term"), F.lit(None).cast("int").alias("id"), F.col("held").alias("n"), F.col("whole").alias("total"), "kept")
    rows = cells.select("lang", "part", F.lit(1).alias("role"), "source", "term", "id", "n", "total", F.lit(None).cast("long").alias("kept"))
    dealt = heads.unionByName(rows).repartition("lang", "part").sortWithinPartitions("lang", "part", "role", "source")
    values = compared(dealt, best)
    none = sources.where("kept = 0").select("lang", "source")
    others = none.select(F.col("lang").alias("of"), F.col("source").alias("item"))
    zero = none.join(others, (F.col("lang") == F.col("of")) & (F.col("source") != F.col("item"))).select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("long").alias("value"))
    summed = values.unionByName(zero).groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    ranked = summed.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= best)).select("lang", "source", "part", "item", "value", "rank")


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
occurrence AS (
  SELECT doc, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*)::BIGINT AS total FROM occurrence GROUP BY lang, term HAVING count(DISTINCT doc) >= 3),
whole AS (SELECT lang, count(*)::BIGINT AS v, sum(total)::BIGINT AS n FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
cell AS (SELECT o.lang, o.source, o.term, count(*)::BIGINT AS c FROM occurrence o JOIN kept USING (lang, term) GROUP BY ALL),
held AS (SELECT lang, source, sum(c)::BIGINT AS n FROM cell GROUP BY ALL),
grid AS (
  SELECT g.lang, g.source, k.term, coalesce(cell.c, 0) AS c, k.total,
    1 + (1000000000 * (coalesce(cell.c, 0) + 1)) // (coalesce(held.n, 0) + w.v) AS p,
    1 + (1000000000 * (k.total + 1)) // (w.n + w.v) AS q
  FROM groups g JOIN kept k USING (lang) JOIN whole w USING (lang)
  LEFT JOIN held USING (lang, source) LEFT JOIN cell ON cell.lang = g.lang AND cell.source = g.source AND cell.term = k.term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p)::BIGINT AS value
  FROM grid a JOIN grid b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
all_pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pairs.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // q AS value FROM grid WHERE c > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
  FROM (SELECT * FROM all_pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
