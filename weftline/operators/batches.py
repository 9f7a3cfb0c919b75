"""Batches of texts of similar length under a bound that falls with the length."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SEGMENTS = "grp string, length long, before long, first long, last long, batch long, size long, at long"


def cut(lengths: list[int], counts: list[int], cap: Callable[[int], int]) -> list[tuple[int, int, int, int, int, int]]:
    """(index of the length, first rank, last rank, batch of the first, size, ranks of that batch before the first) of stretches.

    Ranks run over all items by length. A batch starts with as many items as its first length allows; if its last item
    is longer and allows fewer, it takes as many as that one allows. Batches of one length alone are all alike, so a
    stretch of them is one row, however many items it holds.
    """
    ends, total = [], 0
    for n in counts:
        total += n
        ends.append(total)
    out: list[tuple[int, int, int, int, int, int]] = []
    start, batch, i = 0, 0, 0
    while start < total:
        while ends[i] <= start:
            i += 1
        size = max(1, cap(lengths[i]))
        full = (ends[i] - start) // size
        if full:
            out.append((i, start, start + full * size - 1, batch, size, 0))
            start, batch = start + full * size, batch + full
            continue
        end, j = min(start + size, total), i
        while ends[j] < end:
            j += 1
        end = min(end, start + max(1, cap(lengths[j])))
        at, k = start, i
        while at < end:
            stop = min(end, ends[k])
            out.append((k, at, stop - 1, batch, end - start, at - start))
            at, k = stop, k + 1
        start, batch = end, batch + 1
    return out


def pack_by_length(items: DataFrame, cap: Callable[[int], int]) -> DataFrame:
    """grp, id, length -> the same with batch: batches of each group in order of length, then of id.

    What decides is how many items have each length, so that only these counts go through one task for a group; items
    find their stretch by their rank among the items of their length.
    """
    counts = items.groupBy("grp", "length").agg(F.count(F.lit(1)).alias("n"))

    def plan(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("length")
        lengths, n = rows.length.tolist(), rows.n.tolist()
        before = [0]
        for x in n:
            before.append(before[-1] + x)
        out = [(rows.grp.iloc[0], lengths[i], before[i], first, last, batch, size, at) for i, first, last, batch, size, at in cut(lengths, n, cap)]
        return pd.DataFrame(out, columns=["grp", "length", "before", "first", "last", "batch", "size", "at"])

    segments = counts.groupBy("grp").applyInPandas(plan, SEGMENTS)
    ranked = items.withColumn("rank", F.row_number().over(Window.partitionBy("grp", "length").orderBy("id")) - 1)
    s = segments.select(F.col("grp").alias("g"), F.col("length").alias("l"), "before", "first", "last", F.col("batch").alias("base"), "size", "at")
    place = F.col("rank") + F.col("before")
    joined = ranked.join(s, (F.col("grp") == F.col("g")) & (F.col("length") == F.col("l")) & place.between(F.col("first"), F.col("last")))
    return joined.select("grp", "id", "length", (F.col("base") + F.floor((place - F.col("first") + F.col("at")) / F.col("size"))).cast("long").alias("batch"))
