"""The model of a dependency diagram: canonical edges, fan-in pipes, text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Arrows by character.
ARROWS = {"x": "<-->", "<": "-->", "d": "-.->", "S": "==>", "s": "..>"}
PIPE_FROM = 3


def canonical(links: DataFrame) -> DataFrame:
    """One edge for each unordered pair and kind: ``>`` is drawn as ``<`` the other way; mutual wins over both."""
    flip = F.col("ch") == ">"
    e = links.select(F.when(flip, F.col("dst")).otherwise(F.col("src")).alias("src"), F.when(flip, F.col("src")).otherwise(F.col("dst")).alias("dst"), F.when(flip, "<").otherwise(F.col("ch")).alias("ch"))
    pair = e.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "src", "dst", "ch")
    g = pair.groupBy("a", "b").agg(
        F.bool_or(F.col("ch") == "x").alias("x"),
        F.bool_or((F.col("ch") == "<") & (F.col("src") == F.col("a"))).alias("ab"),
        F.bool_or((F.col("ch") == "<") & (F.col("src") == F.col("b"))).alias("ba"),
        F.max(F.when(~F.col("ch").isin("x", "<"), F.col("ch"))).alias("other"),
    )
    mutual = F.col("x") | (F.col("ab") & F.col("ba"))
    ch = F.when(mutual, "x").when(F.col("ab") | F.col("ba"), "<").otherwise(F.col("other"))
    turned = ~mutual & F.col("ba")
    return g.select(F.when(turned, F.col("b")).otherwise(F.col("a")).alias("src"), F.when(turned, F.col("a")).otherwise(F.col("b")).alias("dst"), ch.alias("ch"))


def visible(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges worth drawing: no p or s, no x between parent and child, no file with directory unless d. nodes: node, parent, is_dir."""
    a = nodes.select(F.col("node").alias("src"), F.col("parent").alias("src_parent"), F.col("is_dir").alias("src_dir"))
    b = nodes.select(F.col("node").alias("dst"), F.col("parent").alias("dst_parent"), F.col("is_dir").alias("dst_dir"))
    j = edges.where("ch NOT IN ('p', 's', 'o', '.', 'n')").join(a, "src").join(b, "dst")
    related = (F.col("src_parent").eqNullSafe(F.col("dst"))) | (F.col("dst_parent").eqNullSafe(F.col("src")))
    return j.where(~((F.col("ch") == "x") & related)).where((F.col("src_dir") == F.col("dst_dir")) | (F.col("ch") == "d")).select("src", "dst", "ch")


def pipe_width(n: Column) -> Column:
    return F.least(2 + 4 * F.log2(n.cast("double")), F.lit(18.0))


def pipes(edges: DataFrame, least: int = PIPE_FROM) -> DataFrame:
    """dst, ch with many sources become one pipe."""
    g = edges.groupBy("dst", "ch").agg(F.countDistinct("src").alias("sources")).where(F.col("sources") >= least)
    return g.withColumn("width", pipe_width(F.col("sources")))


def mermaid(edges: DataFrame, title: str = "flowchart LR") -> DataFrame:
    """One row: the diagram's text, in order of source and target. A diagram is a small result by its nature."""
    arrow = F.coalesce(*[F.when(F.col("ch") == c, a) for c, a in ARROWS.items()], F.lit("---"))
    safe = lambda c: F.concat(F.lit("n"), F.regexp_replace(F.col(c).cast("string"), "[^A-Za-z0-9]", "_"))
    lines = edges.select(F.struct("src", "dst", F.concat(F.lit("  "), safe("src"), F.lit(" "), arrow, F.lit(" "), safe("dst")).alias("line")).alias("x"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n")
    return lines.agg(F.concat_ws("\n", F.lit(title), body).alias("text"))
