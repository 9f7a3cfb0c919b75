"""Writers: trackers, exports, cycles, reports; staged, so that a failed batch leaves nothing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def tracker_text(definitions: DataFrame, rows: DataFrame, stamp: str) -> DataFrame:
    """tracker, content: what ``sources.trackers`` reads. definitions: tracker, ord, key, path; rows: tracker, key, row."""
    joined = definitions.join(rows, ["tracker", "key"], "left")
    g = joined.groupBy("tracker").agg(F.array_sort(F.collect_list(F.struct("ord", "key", "path", F.coalesce("row", F.lit("")).alias("row")))).alias("x"))
    lines = lambda f: F.array_join(F.transform("x", f), "\n")
    return g.select(
        "tracker",
        F.concat_ws(
            "\n",
            F.lit("---KEY_DEFINITIONS_START---"), lines(lambda x: F.concat(x["key"], F.lit(": "), x["path"])), F.lit("---KEY_DEFINITIONS_END---"), F.lit(""),
            F.lit(f"last_KEY_edit: {stamp}"), F.lit(f"last_GRID_edit: {stamp}"), F.lit(""),
            F.lit("---GRID_START---"), F.concat(F.lit("X "), F.array_join(F.transform("x", lambda x: x["key"]), " ")), lines(lambda x: F.concat(x["key"], F.lit(" = "), x["row"])), F.lit("---GRID_END---"),
        ).alias("content"),
    )


def checklist(coverage: DataFrame) -> DataFrame:
    """One line for each module: how far it is documented."""
    return coverage.select(F.format_string("- [%s] %s: %.1f%% of %d files", F.when(F.col("coverage") >= 100, "x").otherwise(" "), "module", F.col("coverage").cast("double"), "files").alias("value"))


def issue_lines(issues: DataFrame) -> DataFrame:
    return issues.select(F.format_string("- **%s** `%s:%d` %s", "severity", F.col("file").cast("string"), "line", "subtype").alias("value"))


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def commit_all(spark: SparkSession, batch: dict[str, DataFrame], fmt: str = "parquet", keep: int = 2) -> None:
    """Writes every frame beside its target, then moves all into place; if one fails, none has changed.

    The former contents become backups, of which ``keep`` stay.
    """
    token, staged = uuid.uuid4().hex, {}
    try:
        for target, df in batch.items():
            df.write.format(fmt).save(f"{target}.staged-{token}")
            staged[target] = f"{target}.staged-{token}"
    except Exception:
        for path in [*staged.values(), *(f"{t}.staged-{token}" for t in batch)]:
            fs, make = _fs(spark, path)
            fs.delete(make(path), True)
        raise
    moved: list[tuple[str, str]] = []  # from, to; undone backwards
    try:
        for target, path in staged.items():
            fs, make = _fs(spark, target)
            if fs.exists(make(target)):
                versions = _backups(spark, target)
                _move(spark, target, f"{target}.backup-{(versions[0] if versions else 0) + 1}", moved)
            _move(spark, path, target, moved)
    except Exception:
        for source, to in reversed(moved):
            _move(spark, to, source, [])
        for path in staged.values():
            fs, make = _fs(spark, path)
            fs.delete(make(path), True)
        raise
    for target in staged:
        fs, make = _fs(spark, target)
        for old in _backups(spark, target)[keep:]:
            fs.delete(make(f"{target}.backup-{old}"), True)


def _backups(spark: SparkSession, target: str) -> list[int]:
    """Numbers of the backups, newest first."""
    fs, make = _fs(spark, target)
    return sorted((int(s.getPath().getName().rpartition("-")[2]) for s in fs.globStatus(make(f"{target}.backup-*"))), reverse=True)


def _move(spark: SparkSession, source: str, target: str, moved: list[tuple[str, str]]) -> None:
    fs, make = _fs(spark, target)
    if not fs.rename(make(source), make(target)):
        raise OSError(f"cannot move {source} to {target}")
    moved.append((source, target))


def save_cycle(assignments: DataFrame, path: str) -> None:
    """Adds or replaces the cycles in ``assignments``, a folder each."""
    assignments.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("cycle").parquet(path)


def retained(cycles: DataFrame, keep: int = 5) -> DataFrame:
    """Rows of the newest ``keep`` cycles."""
    order = cycles.select("cycle").distinct().withColumn("nth", F.row_number().over(Window.orderBy(F.desc("cycle"))))
    return cycles.join(order.where(F.col("nth") <= keep).select("cycle"), "cycle", "left_semi")


def export(cells: DataFrame, path: str, fmt: str) -> None:
    """json, csv, or dot lines of the cells that say something."""
    said = cells.where("ch NOT IN ('.', 'o', 'p')")
    if fmt == "dot":
        src, dst = F.col("src").cast("string"), F.col("dst").cast("string")
        said.select(F.format_string('  "%s" -> "%s" [label="%s"];', src, dst, "ch").alias("value")).write.mode("overwrite").text(path)
    elif fmt in ("json", "csv"):
        said.write.mode("overwrite").option("header", "true").format(fmt).save(path)
    else:
        raise ValueError(f"no such export: {fmt}")
