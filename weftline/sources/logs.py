"""Logs of suggestions and scans, and files of cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCAN = "source string, target string, confidence double, cycle int"
PATH = r"(?:[A-Za-z]:)?/[^\s']+"


def suggestions(lines: DataFrame) -> DataFrame:
    """value -> source, target, ch, confidence of lines that suggest an edge, in either of two forms."""
    v = F.col("value")
    one = rf"Suggesting '(.)' from ({PATH}) to ({PATH}) \(confidence: ([0-9.]+)\)"
    two = rf"({PATH}) -> ({PATH}) \[(.)\] score=([0-9.]+)"
    pick = lambda i, j: F.coalesce(F.nullif(F.regexp_extract(v, one, i), F.lit("")), F.nullif(F.regexp_extract(v, two, j), F.lit("")))
    rows = lines.select(pick(2, 1).alias("source"), pick(3, 2).alias("target"), pick(1, 3).alias("ch"), pick(4, 4).try_cast("double").alias("confidence"))
    return rows.where("source IS NOT NULL AND confidence IS NOT NULL")


def scans(lines: DataFrame) -> DataFrame:
    """value -> source, target, confidence, cycle, state (ok, repaired, skipped): cut lines get their bracket back."""
    whole, mended = F.from_json("value", SCAN), F.from_json(F.concat("value", F.lit("}")), SCAN)
    good = lambda s: s["source"].isNotNull() & s["target"].isNotNull() & s["confidence"].isNotNull()
    r = lines.where(F.trim("value") != "").select(whole.alias("w"), mended.alias("m"))
    state = F.when(good(F.col("w")), "ok").when(good(F.col("m")), "repaired").otherwise("skipped")
    s = F.when(good(F.col("w")), F.col("w")).when(good(F.col("m")), F.col("m"))
    return r.select(s["source"].alias("source"), s["target"].alias("target"), s["confidence"].alias("confidence"), s["cycle"].alias("cycle"), state.alias("state"))


def cycle_pairs(cycles: DataFrame, most: int = 10) -> DataFrame:
    """cycle, all_pairs, top, bottom -> distinct (source, target) of the last cycles; older files have only their extremes."""
    last = F.dense_rank().over(Window.orderBy(F.desc("cycle")))  # one row a cycle file
    p = cycles.withColumn("nth", last).where(F.col("nth") <= most)
    pairs = F.when(F.size("all_pairs") > 0, F.col("all_pairs")).otherwise(F.concat(F.coalesce("top", F.array()), F.coalesce("bottom", F.array())))
    return p.select(F.explode(pairs).alias("x")).select("x.source", "x.target").where("source IS NOT NULL AND target IS NOT NULL").distinct()


def repair_pairs(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs without a missing end; ends that look like keys become paths."""
    k = nodes.select("key", "path")
    a = pairs.where("source IS NOT NULL AND target IS NOT NULL").join(k.select(F.col("key").alias("sk"), F.col("path").alias("sp")), F.col("source") == F.col("sk"), "left")
    b = a.join(k.select(F.col("key").alias("tk"), F.col("path").alias("tp")), F.col("target") == F.col("tk"), "left")
    return b.select(F.coalesce("sp", "source").alias("source"), F.coalesce("tp", "target").alias("target")).distinct()
