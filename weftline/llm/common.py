"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.session import shared_dir

#: Text handled at once inside a Python worker; bounds the numpy scratch space.
CHUNK_CHARS = 400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spool(df: DataFrame, label: str) -> DataFrame:
    """Cuts lineage: writes ``df`` as Parquet in the shared folder and rereads it.

    A lost executor costs nothing that is not in that folder.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is never sent to the driver and broadcast.

    Estimates of rows that Python or an explode multiplies follow their input, and can be too low by any factor.
    """
    return df.hint("merge")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Just the two columns an operator reads, under names of its own."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def chunks(texts: list[str], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` that hold about ``limit`` characters; a longer text stands alone."""
    start, held = 0, 0
    for i, x in enumerate(texts):
        if held and held + len(x) > limit:
            yield start, i
            start, held = i, 0
        held += len(x) + 1
    if start < len(texts):
        yield start, len(texts)


def text_batches(batches: Iterator[pa.RecordBatch], limit: int = CHUNK_CHARS, rows: int = 512) -> Iterator[tuple[list, list[str | None]]]:
    """(ids, texts) in pieces of bounded size."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            ids, texts = b.column(0).slice(at, rows).to_pylist(), b.column(1).slice(at, rows).to_pylist()
            for i, j in chunks([x or "" for x in texts], limit):
                yield ids[i:j], texts[i:j]
    trim()


def trim() -> None:
    """Gives freed memory back, so that workers that wait for their next task are small."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # only where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def as_bytes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as UTF-8 with one zero byte after each, and each text's first byte (one more at the end)."""
    raw = [x.encode("utf-8", "surrogatepass") for x in texts]
    starts = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(x) + 1 for x in raw], out=starts[1:])
    return np.frombuffer(b"\0".join(raw) + b"\0", np.uint8), starts


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def null_safe(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))
