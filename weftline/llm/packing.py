"""Best-fit packing in a tree of rounds (operator 5).

A text becomes token ids and an end id; one longer than a sequence is cut into
full pieces, its short rest first. Each task packs its pieces best-fit,
largest first. Bins that are nearly full are finished; the others go up as
single items to fewer, mixed tasks, which pack them again, and so on until one
task holds all that is left, or a round leaves more than 95 per cent of its open
bins open and they are more than one task packs, or after twelve rounds. These
ends can leave bins that further rounds would have merged; no piece is lost.

Rounds move (bin, size) pairs only. Piece rows stay where they were packed and
learn their final place from the bins' moves at the end.

Defined results: a null or empty text is its end id alone; equal sizes go in
order of id; a row that repeats is a piece of its own; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import bpe
from weftline.llm.common import id_text, partitions, spool, table, text_batches

#: A bin with less room than this is finished at once.
SLACK = 8
#: Items that are packed together, in every round: a task packs as it collects so many.
TASK_ITEMS = 200_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, at long"


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset in it) of each item and the bins' loads: largest first, each into the fullest bin that still takes it."""
    bins, at = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, loads = 0, []
    for i in np.argsort(-sizes, kind="stable").tolist():
        n = int(sizes[i])
        fits = mask >> n
        if fits:
            left = n + (fits & -fits).bit_length() - 1
            b = room[left].pop()
            if not room[left]:
                mask &= ~(1 << left)
        else:
            left, b = capacity, len(loads)
            loads.append(0)
        bins[i], at[i] = b, loads[b]
        loads[b] += n
        left -= n
        if left:
            room[left].append(b)
            mask |= 1 << left
    return bins, at, np.array(loads, np.int64)


def _bin_ids(task: int, count: int, level: int) -> np.ndarray:
    """Numbers that no other task or level gives out."""
    return (np.int64(level) << np.int64(58)) + (np.int64(task) << np.int64(34)) + np.arange(count, dtype=np.int64)


def pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """PIECES: every piece in a bin of its own task (level 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        cache, task, given = bpe.rank_cache(vocabulary), TaskContext.get().partitionId(), 0
        cols: list[list] = [[] for _ in range(5)]

        def packed() -> pa.RecordBatch:
            nonlocal given
            bins, at, loads = best_fit(np.array(cols[3], np.int64), capacity)
            ids = _bin_ids(task, given + len(loads), 0)[given:]
            given += len(loads)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(cols, kinds, strict=True)), pa.array(ids[bins]), pa.array(at)], [x.split()[0] for x in PIECES.split(", ")])

        for keys, texts in text_batches(batches, bpe.ENCODE_CHARS, bpe.ENCODE_ROWS):
            for key, ids in zip(keys, bpe.encode_texts([x or "" for x in texts], cache), strict=True):
                ids = np.append(ids, end_id).astype("<u4")
                first = (len(ids) - 1) % capacity + 1
                cuts = [0, *range(first, len(ids) + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    for c, v in zip(cols, (key, k, a, b - a, zlib.crc32(ids[a:b].tobytes())), strict=True):
                        c.append(v)
            if len(cols[0]) >= TASK_ITEMS:
                yield packed()
                cols = [[] for _ in range(5)]
        if cols[0]:
            yield packed()

    return id_text(docs, id_col, text_col).mapInArrow(run, PIECES)


def _round(items: DataFrame, tasks: int, level: int, capacity: int) -> DataFrame:
    """bin, load -> bin, load, up, at: the bin of this level that each item went into, and where."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, given = TaskContext.get().partitionId(), 0
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if not held:
            return
        old, sizes = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(old)
        for part in range(0, len(order), TASK_ITEMS):
            o = order[part : part + TASK_ITEMS]
            bins, at, loads = best_fit(sizes[o], capacity)
            ids = _bin_ids(task, given + len(loads), level)[given:]
            given += len(loads)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (old[o], sizes[o], ids[bins], at, loads[bins])], ["bin", "size", "up", "at", "up_load"])

    return items.repartition(tasks, F.xxhash64("bin")).mapInArrow(run, "bin long, size long, up long, at long, up_load long")


def pack(docs: DataFrame, vocabulary: str, end_id: int, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row for each piece."""
    spark = docs.sparkSession
    base = spool(pieces(docs, vocabulary, end_id, capacity, id_col, text_col), "packed")
    loads = base.groupBy("bin").agg(F.sum("length").alias("load"))
    open_bins = loads.where(F.col("load") <= capacity - SLACK)
    level, moves, tasks, before = 0, None, partitions(spark), None
    while True:
        level += 1
        open_bins = spool(open_bins, f"bins{level}")
        left = open_bins.count()
        if left <= 1 or level > 12 or before is not None and left > 0.95 * before and tasks == 1:
            break
        if before is not None and left > 0.95 * before and left > TASK_ITEMS:
            break
        tasks = max(1, min(tasks // 4, -(-left // 4096)), -(-left // TASK_ITEMS))
        step = spool(_round(open_bins, tasks, level, capacity), f"moves{level}")
        new = step.select("bin", "up", "at")
        if moves is None:
            moves = new
        else:
            m, n = moves.alias("m"), new.alias("n")
            moves = m.join(n, F.col("m.up") == F.col("n.bin"), "left").select("m.bin", F.coalesce("n.up", "m.up").alias("up"), (F.col("m.at") + F.coalesce("n.at", F.lit(0))).alias("at"))
        open_bins = step.groupBy(F.col("up").alias("bin")).agg(F.sum("size").alias("load")).where(F.col("load") <= capacity - SLACK)
        before = left
        if tasks == 1:
            break
    if moves is None:
        return base.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), F.col("at").alias("offset"))
    moves = moves.select(F.col("bin").alias("moved"), "up", F.col("at").alias("shift"))
    placed = base.join(moves, base["bin"] == moves["moved"], "left")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("up", "bin").alias("sequence_id"), (F.col("at") + F.coalesce("shift", F.lit(0))).alias("offset"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
