"""Whitening of embeddings by a tall-skinny QR factorisation (operator 12).

Each entry c becomes the integer ``floor(64 c) + 1000000``. The fit list is each
distinct integer vector once. Its sums are exact; rows centred by them are
factorised per partition (Q is never kept), the triangular factors merge up a
tree, eight at a time, and the singular values and right vectors of the last one
whiten. The covariance matrix is never formed, so its condition is not squared.

Vectors of each length are a space of their own, with a fit of its own.

Defined results: rows whose vector is null or empty or holds a null, NaN or
infinity are dropped, and so are those with an entry of 2 ** 46 or more in size,
whose integers would not be exact; equal vectors count once in the fit and get
a row each; a row without an id keeps its null; an empty table gives no rows.
Directions without variance (eigenvalues below 1e-24 of the largest, as where
all vectors are equal) cannot be whitened and are no components. A deviation
too large for a long is null. Components with equal eigenvalues have no order
of their own; every row uses the same vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import spool, table, trim

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Triangular factors that one task of the tree stacks.
FAN_IN = 8
#: Entries of vectors held at once.
BLOCK = 1 << 20
#: Eigenvalues below this share of the largest are no variance.
LEAST_SHARE = 1e-24


@dataclass(frozen=True)
class Whitener:
    """What one length's vectors are whitened with. All of it is bounded by components x length."""

    n: int
    sums: np.ndarray  # of the unshifted integers, objects
    vectors: np.ndarray  # (components, length)
    eigenvalues: np.ndarray
    trace: float


def integers(vec: Column) -> Column:
    """floor(64 c), unshifted, or null where the vector cannot be used."""
    usable = (F.size(vec) > 0) & F.forall(vec, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < F.lit(float(1 << 46))))
    return F.when(usable, F.transform(vec, lambda c: F.floor(c.cast("double") * F.lit(float(SCALE)))))


def blocks(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, matrix of int64) of the vectors of each length, a block at a time."""
    lengths = np.array(column.value_lengths())
    for d in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == d)
        step = max(1, BLOCK // d)
        for i in range(0, len(at), step):
            some = at[i : i + step]
            yield some, np.asarray(column.take(pa.array(some)).flatten()).reshape(-1, d)


def exact_sums(fit: DataFrame) -> list:
    """Rows of d, n, and the exact sum of each position (decimals); one row for each length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, list[int]]] = {}
        for b in batches:
            for _, x in blocks(b.column(0)):
                # High and low halves are summed apart, so that no sum overflows.
                high, low = (x >> 26).sum(0), (x & ((1 << 26) - 1)).sum(0)
                n, old = held.get(x.shape[1], (0, [0] * x.shape[1]))
                held[x.shape[1]] = n + len(x), [o + (h << 26) + v for o, h, v in zip(old, high.tolist(), low.tolist(), strict=True)]
        for d, (n, sums) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array(map(str, sums), pa.string())], ["d", "pos", "n", "s"])

    parts = fit.mapInArrow(run, "d int, pos int, n long, s string")
    whole = parts.groupBy("d", "pos").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).cast("string").alias("s"))
    # At most as many rows as the vectors of each length have entries.
    return whole.orderBy("d", "pos").collect()


def _factor(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r") if len(rows) else rows


def last_factors(fit: DataFrame, means: dict[int, np.ndarray]) -> DataFrame:
    """d, r: the triangular factor of all centred vectors of each length, row by row in one array."""
    schema = "d int, part int, r array<double>"

    def told(found: dict[int, np.ndarray], part: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([part] * len(found), pa.int32()), pa.array([r.ravel() for r in found.values()], pa.list_(pa.float64()))], ["d", "part", "r"])

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        part = 0
        for b in batches:
            part = b.column(1)[0].as_py() if b.num_rows else part
            for _, x in blocks(b.column(0)):
                d = x.shape[1]
                found[d] = _factor(np.concatenate([found.get(d, np.zeros((0, d))), x - means[d]]))
        if found:
            yield told(found, part)
        trim()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, np.zeros((0, 0))
        for b in batches:
            for d, part, r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                r = np.asarray(r.values).reshape(-1, d)
                if now != (d, part):
                    if now:
                        yield told({now[0]: held}, now[1])
                    now, held = (d, part), np.zeros((0, d))
                held = _factor(np.concatenate([held, r]))
        if now:
            yield told({now[0]: held}, now[1])

    factors = spool(fit.withColumn("part", F.spark_partition_id()).mapInArrow(leaves, schema), "factors")
    parts = (factors.agg(F.max("part")).first()[0] or 0) + 1
    while parts > 1:
        grouped = factors.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int")).repartition("d", "part").sortWithinPartitions("d", "part")
        factors = spool(grouped.mapInArrow(merge, schema), "factors")
        parts = -(-parts // FAN_IN)
    return factors.select("d", "r")


def fit(vectors: DataFrame, components: int = COMPONENTS) -> dict[int, Whitener]:
    """The whitener of each length of the distinct vectors ``vectors`` (x array<long>)."""
    sums: dict[int, list[int]] = {}
    counts: dict[int, int] = {}
    for row in exact_sums(vectors):
        sums.setdefault(row["d"], []).append(int(row["s"]))
        counts[row["d"]] = row["n"]
    means = {d: np.array([float(x // counts[d]) + (x % counts[d]) / counts[d] for x in s]) for d, s in sums.items()}

    def decompose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, r in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                _, s, right = np.linalg.svd(np.asarray(r.values).reshape(-1, d), full_matrices=False)
                e = s * s / counts[d]
                kept = min(components, int((e > LEAST_SHARE * max(e[0], 1e-300)).sum()))
                yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([float(e.sum())]), pa.array([e[:kept]], pa.list_(pa.float64())), pa.array([right[:kept].ravel()], pa.list_(pa.float64()))], ["d", "trace", "e", "v"])

    found = last_factors(vectors, means).mapInArrow(decompose, "d int, trace double, e array<double>, v array<double>").collect()
    return {r["d"]: Whitener(counts[r["d"]], np.array(sums[r["d"]], object), np.array(r["v"]).reshape(-1, r["d"]), np.array(r["e"]), r["trace"]) for r in found}


def centred(x: np.ndarray, w: Whitener) -> np.ndarray:
    return x - np.array([float(s // w.n) + (s % w.n) / w.n for s in w.sums])


def whitened(x: np.ndarray, w: Whitener) -> np.ndarray:
    """(rows, components)."""
    return centred(x, w) @ w.vectors.T / np.sqrt(w.eigenvalues)


def deviations(x: np.ndarray, w: Whitener) -> list[int | None]:
    """The exact sum of (n x - S) ** 2 of each row."""
    most = w.n * int(np.abs(x).max(initial=0)) + max(map(abs, w.sums), default=0)
    if most * most * max(x.shape[1], 1) < 1 << 63:
        return ((w.n * x - w.sums.astype(np.int64)) ** 2).sum(1).tolist()
    exact = ((w.n * x.astype(object) - w.sums) ** 2).sum(1).tolist()
    return [v if v < 1 << 63 else None for v in exact]


def identity_error(fit_list: DataFrame, models: dict[int, Whitener]) -> dict[int, float]:
    """The largest entry, in size, of the whitened fit list's covariance less the identity, for each length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for _, x in blocks(b.column(0)):
                w = whitened(x, models[x.shape[1]])
                held[x.shape[1]] = held.get(x.shape[1], 0) + w.T @ w
        for d, m in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([d] * m.size, pa.int32()), pa.array(range(m.size), pa.int32()), pa.array(m.ravel(), pa.float64())], ["d", "at", "v"])

    # At most components ** 2 rows for each length.
    whole = fit_list.mapInArrow(run, "d int, at int, v double").groupBy("d", "at").agg(F.sum("v").alias("v")).orderBy("d", "at").collect()
    out: dict[int, float] = {}
    for row in whole:
        m = models[row["d"]]
        i, j = divmod(row["at"], len(m.eigenvalues))
        out[row["d"]] = max(out.get(row["d"], 0.0), abs(row["v"] / m.n - (i == j)))
    return out


def whiten(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each usable vector and component."""
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), integers(F.col(vec_col)).alias("x")).where("x IS NOT NULL")
    fit_list = spool(rows.select("x").distinct(), "fit")
    models = fit(fit_list, components)
    errors = identity_error(fit_list, models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, x in blocks(b.column(1)):
                m = models[x.shape[1]]
                k = len(m.eigenvalues)
                if not k:
                    continue
                ids = b.column(0).take(pa.array(np.repeat(at, k)))
                deviation = pa.array(deviations(x, m), pa.int64()).take(pa.array(np.repeat(np.arange(len(at)), k)))
                many = lambda v: pa.array(np.tile(v, len(at)))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [ids, many(np.arange(1, k + 1, dtype=np.int32)), pa.array(np.full(len(at) * k, m.n, np.int64)), deviation, pa.array(whitened(x, m).ravel()), many(m.eigenvalues / m.trace), pa.array(np.full(len(at) * k, errors[x.shape[1]]))],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
