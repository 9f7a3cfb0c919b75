"""Tracker documents: key definitions, a header, and coded rows between markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The markers and line forms of the format.
DEFINITIONS = r"(?s)---KEY_DEFINITIONS_START---(.*?)---KEY_DEFINITIONS_END---"
GRID = r"(?s)---GRID_START---(.*?)---GRID_END---"
STAMP = r"(?m)^last_(KEY|GRID)_edit: *(.*)$"
DEFINITION_LINE = r"(?m)^([0-9][^\s:]*): +(\S.*?)\s*$"
GRID_LINE = r"(?m)^([0-9]\S*) = (\S*)\s*$"


def _pairs(text: Column, pattern: str) -> Column:
    return F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("a"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("b"))


def read(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """tracker, content of every tracker below ``path``."""
    from weftline.sources.files import read_text

    return read_text(spark, path, glob).select(F.col("path").alias("tracker"), "content")


def definitions(docs: DataFrame) -> DataFrame:
    """tracker, ord, key, path."""
    part = F.regexp_extract("content", DEFINITIONS, 1)
    return docs.select("tracker", F.posexplode(_pairs(part, DEFINITION_LINE)).alias("ord", "d")).select("tracker", "ord", F.col("d.a").alias("key"), F.col("d.b").alias("path"))


def header(docs: DataFrame) -> DataFrame:
    """tracker, ord, key of the grid's columns; a tracker without a header takes the order of its definitions."""
    part = F.regexp_extract("content", GRID, 1)
    named = F.regexp_extract(part, r"(?m)^X +(.*?)\s*$", 1)
    keys = F.when(named != "", F.split(named, " +")).otherwise(F.transform(_pairs(F.regexp_extract("content", DEFINITIONS, 1), DEFINITION_LINE), lambda d: d["a"]))
    return docs.select("tracker", F.posexplode(keys).alias("ord", "key"))


def rows(docs: DataFrame) -> DataFrame:
    """tracker, ord, key, row."""
    part = F.regexp_extract("content", GRID, 1)
    return docs.select("tracker", F.posexplode(_pairs(part, GRID_LINE)).alias("ord", "r")).select("tracker", "ord", F.col("r.a").alias("key"), F.col("r.b").alias("row"))


def stamps(docs: DataFrame) -> DataFrame:
    """tracker, kind, value of the edit stamps."""
    return docs.select("tracker", F.explode(_pairs(F.col("content"), STAMP)).alias("s")).select("tracker", F.lower("s.a").alias("kind"), F.col("s.b").alias("value"))


def cells(docs: DataFrame) -> DataFrame:
    """tracker, src, dst, ch: the grids as edges, addressed by ordinal."""
    from weftline.functions import codec

    columns = header(docs).groupBy("tracker").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "key"))), lambda k: k["key"]).alias("keys"))
    r = rows(docs).join(columns, "tracker")
    pairs = r.select("tracker", F.col("key").alias("src"), F.explode(F.arrays_zip(F.col("keys").alias("dst"), F.split(codec.decode(F.col("row")), "").alias("ch"))).alias("c"))
    return pairs.select("tracker", "src", F.col("c.dst").alias("dst"), F.col("c.ch").alias("ch")).where("ch IS NOT NULL AND ch NOT IN ('o', '.', '') AND src <> dst")
