"""Issues of code: where they lie, what they weigh, which are shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rank of severities in reports.
SEVERITY_RANK = {"critical": 0, "high": 1, "medium": 2, "low": 3}
CALLERS, ACCESSES = 20, 25


def smallest_enclosing(issues: DataFrame, ranges: DataFrame) -> DataFrame:
    """issues (issue, file, line) with the innermost range (file, symbol, start, stop) around each; null if none.

    Candidates meet on (file, block of lines), so neither a long file nor a long range gathers in one task; each
    issue then takes the least range with partial aggregation.
    """
    width = 256
    r = ranges.select(F.col("file").alias("r_file"), "symbol", "start", "stop", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("stop") / width))).alias("r_block"))
    i = issues.withColumn("block", F.floor(F.col("line") / width))
    hit = i.join(r, (i["file"] == r["r_file"]) & (i["block"] == r["r_block"]) & (i["line"] >= r["start"]) & (i["line"] <= r["stop"]))
    best = hit.groupBy("issue", "file", "line").agg(F.min(F.struct((F.col("stop") - F.col("start")).alias("size"), "start", "symbol")).alias("b"))
    return issues.join(best.select("issue", "file", "line", F.col("b.symbol").alias("symbol")), ["issue", "file", "line"], "left")


# Points of subtypes.
SUBTYPE_POINTS = {"Annotated Stub": 2, "Exported Placeholder": 2, "Concrete Stub Method": 2, "Empty/Stub Function": 1, "Empty/Stub Class": 1, "Async Stub": 1}


def callers(names: DataFrame, references: DataFrame, most: int = CALLERS) -> DataFrame:
    """name, own file -> the first ``most`` other files that refer to it, and how many there are."""
    j = names.join(references.select(F.col("name").alias("r_name"), F.col("file").alias("caller")).distinct(), (F.col("name") == F.col("r_name")) & (F.col("file") != F.col("caller")), "left")
    ranked = j.withColumn("nth", F.row_number().over(Window.partitionBy("name", "file").orderBy("caller")))
    return ranked.groupBy("name", "file").agg(F.count("caller").alias("n_callers"), F.array_sort(F.collect_list(F.when(F.col("nth") <= most, F.col("caller")))).alias("callers"))


def points(subtype: Column, n_callers: Column, exported: Column) -> Column:
    """Points of an issue: what it is, whether anyone calls it, whether it leaves its module."""
    raises = F.when(F.contains(subtype, F.lit("NotImplementedError")), 2).otherwise(0)
    kind = F.lit(0)
    for name, n in SUBTYPE_POINTS.items():
        kind = F.when(subtype == name, n).otherwise(kind)
    return raises + kind + F.when(n_callers > 0, 1).otherwise(0) + F.when(exported, 1).otherwise(0)


def severity(score: Column) -> Column:
    return F.when(score >= 4, "critical").when(score >= 2, "high").when(score >= 1, "medium").otherwise("low")


def suppressed(kind: Column, name: Column, in_test: Column, abstract: Column) -> Column:
    """Findings that are no fault: abstract or protocol members, exceptions that only mark, test doubles, data holders, dunder methods, overloads."""
    return abstract | (in_test & kind.isin("stub", "Empty/Stub Function")) | name.rlike("(Error|Exception|Warning)$") | name.rlike(r"^__\w+__$") | name.rlike("(Protocol|Mixin|ABC)$") | (kind == "overload")


def dedupe(issues: DataFrame) -> DataFrame:
    """One issue of (file, line, subtype): the richest context, then the first."""
    best = issues.groupBy("file", "line", "subtype").agg(F.max_by(F.struct("issue", "context_size"), F.struct("context_size", (-F.col("issue")).alias("i"))).alias("b"))
    return best.select("file", "line", "subtype", "b.issue", "b.context_size")


def rollups(issues: DataFrame) -> DataFrame:
    """Counts by severity, by subtype, by component, by file, and in all, from one pass."""
    return issues.groupingSets([["severity"], ["subtype"], ["component"], ["file"], []], "severity", "subtype", "component", "file").agg(F.count(F.lit(1)).alias("n"))


def component(path: Column) -> Column:
    return F.initcap(F.regexp_replace(F.regexp_extract(path, "^([^/]+)", 1), "[_-]", " "))


def report_order(issues: DataFrame) -> DataFrame:
    rank = F.coalesce(*[F.when(F.col("severity") == s, r) for s, r in SEVERITY_RANK.items()], F.lit(9))
    return issues.withColumn("rank", rank).orderBy("rank", "file", "line").drop("rank")
