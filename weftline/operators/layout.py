"""Places of a diagram's boxes: sizes from the leaves up, offsets inside each parent, absolute places as sums of offsets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators import tree
from weftline.operators.rounds import spool


@dataclass(frozen=True)
class Measures:
    """Distances in pixels."""

    node_min_width: float = 120.0
    node_height: float = 40.0
    char_width: float = 7.0
    label_padding: float = 24.0
    padding_x: float = 20.0
    padding_y: float = 16.0
    header: float = 28.0
    column_gap: float = 100.0
    row_gap: float = 28.0
    tier_gap: float = 80.0
    canvas: float = 32.0
    column_nodes: int = 9
    stagger: float = 0.5


def columns(nodes: DataFrame, m: Measures) -> DataFrame:
    """nodes with col and pos: children stand in columns by the letter of their key, split evenly where a letter has too many."""
    n = nodes.withColumn("letter", F.coalesce(F.nullif(F.regexp_extract("key", r"^\d+([A-Z])", 1), F.lit("")), F.lit("_")))
    own = Window.partitionBy("parent", "letter")
    n = n.withColumn("i", F.row_number().over(own.orderBy("key", "path")) - 1).withColumn("n", F.count(F.lit(1)).over(own))
    each = F.ceil(F.col("n") / F.ceil(F.col("n") / m.column_nodes))
    n = n.withColumn("sub", F.when(F.col("n") > m.column_nodes, F.floor(F.col("i") / each)).otherwise(F.lit(0)).cast("int"))
    n = n.withColumn("pos", F.row_number().over(Window.partitionBy("parent", "letter", "sub").orderBy("key", "path")) - 1)
    order = n.select("parent", "letter", "sub").distinct().withColumn("col", F.row_number().over(Window.partitionBy("parent").orderBy("letter", "sub")) - 1)
    o = order.select(F.col("parent").alias("p"), F.col("letter").alias("l"), F.col("sub").alias("s"), "col")
    return n.join(o, n["parent"].eqNullSafe(o["p"]) & (n["letter"] == o["l"]) & (n["sub"] == o["s"])).drop("p", "l", "s", "letter", "sub", "i", "n")


def _lower(col: Column, m: Measures) -> Column:
    """How much lower a column starts: every second one by a share of a row."""
    return (col % 2) * F.lit((m.node_height + m.row_gap) * m.stagger)


def sized(nodes: DataFrame, m: Measures) -> DataFrame:
    """nodes (path, parent, is_dir, label, depth, col, pos) with width and height, a level of the tree at a time."""
    longest = F.coalesce(F.array_max(F.transform(F.split("label", "\n"), F.length)), F.lit(0))
    width = F.greatest(F.lit(m.node_min_width), longest * m.char_width + m.label_padding)
    bare = nodes.withColumn("width", width).withColumn("height", F.when(F.col("is_dir"), m.node_height + m.header).otherwise(m.node_height))
    done: DataFrame | None = None
    held: DataFrame | None = None  # sizes that children give their parents, one level up
    for depth in range((nodes.agg(F.max("depth")).first()[0] or 0) if nodes.take(1) else -1, -1, -1):
        level = bare.where(F.col("depth") == depth)
        if held is not None:
            level = level.join(held, F.col("path") == F.col("h_path"), "left").withColumns({"width": F.coalesce("h_width", "width"), "height": F.coalesce("h_height", "height")}).drop("h_path", "h_width", "h_height")
        level = spool(level, "sizes")
        cols = level.groupBy("parent", "col").agg(F.max("width").alias("w"), (F.sum("height") + (F.count(F.lit(1)) - 1) * m.row_gap).alias("h"))
        held = cols.groupBy("parent").agg((F.sum("w") + 2 * m.padding_x + (F.count(F.lit(1)) - 1) * m.column_gap).alias("h_width"), (F.max(F.col("h") + _lower(F.col("col"), m)) + m.header + 2 * m.padding_y).alias("h_height")).withColumnRenamed("parent", "h_path")
        done = level if done is None else done.unionByName(level)
    return bare.limit(0) if done is None else done


def offsets(nodes: DataFrame, m: Measures) -> DataFrame:
    """nodes with dx, dy: places inside the parent; of roots, on the canvas."""
    root = F.col("parent").isNull()
    widths = nodes.groupBy("parent", "col").agg(F.max("width").alias("col_width"))
    before = F.coalesce(F.sum(F.col("col_width") + m.column_gap).over(Window.partitionBy("parent").orderBy("col").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    w = widths.withColumn("left", before).select(F.col("parent").alias("p"), F.col("col").alias("c"), "col_width", "left")
    j = nodes.join(w, nodes["parent"].eqNullSafe(w["p"]) & (nodes["col"] == w["c"])).drop("p", "c")
    column = Window.partitionBy("parent", "col").orderBy("pos")
    gap = F.when(root, m.tier_gap).otherwise(m.row_gap)
    above = F.coalesce(F.sum(F.col("height") + gap).over(column.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    # Roots are centred in what their column was wide when they were placed.
    within = F.when(root, F.max("width").over(column.rowsBetween(Window.unboundedPreceding, 0))).otherwise(F.col("col_width"))
    dx = F.when(root, m.canvas).otherwise(m.padding_x) + F.col("left") + (within - F.col("width")) / 2
    dy = F.when(root, m.canvas).otherwise(m.header + m.padding_y) + _lower(F.col("col"), m) + above
    return j.withColumns({"dx": dx, "dy": dy}).drop("left", "col_width")


def layout(nodes: DataFrame, measures: Measures | None = None) -> DataFrame:
    """nodes (path, parent, is_dir, key, label) -> path, parent, is_dir, x, y, width, height.

    Children lie inside their parents, siblings apart. A node whose parent is no node is a root.
    """
    m = measures or Measures()
    known = nodes.select(F.col("path").alias("k")).distinct()
    n = nodes.join(known, F.col("parent") == F.col("k"), "left").withColumn("parent", F.col("k")).drop("k")
    up = spool(tree.deep_closure(n.select("path", F.col("parent").alias("parent_path"))), "above")
    depth = up.groupBy(F.col("node").alias("d_node")).agg(F.count(F.lit(1)).alias("depth"))
    n = n.join(depth, F.col("path") == F.col("d_node"), "left").withColumn("depth", F.coalesce("depth", F.lit(0))).drop("d_node")
    placed = spool(offsets(sized(spool(columns(n, m), "columns"), m), m), "offsets")
    shift = placed.select(F.col("path").alias("a"), F.col("dx").alias("ax"), F.col("dy").alias("ay"))
    moved = up.join(shift, F.col("ancestor") == F.col("a")).groupBy(F.col("node").alias("m_node")).agg(F.sum("ax").alias("ax"), F.sum("ay").alias("ay"))
    j = placed.join(moved, F.col("path") == F.col("m_node"), "left")
    return j.select("path", "parent", "is_dir", (F.col("dx") + F.coalesce("ax", F.lit(0.0))).alias("x"), (F.col("dy") + F.coalesce("ay", F.lit(0.0))).alias("y"), "width", "height")
