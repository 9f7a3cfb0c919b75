"""Analytics over cycles of scored assignments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Lower ends of the confidence buckets.
BUCKETS = (("excellent", 0.9, 2.0), ("good", 0.7, 0.9), ("fair", 0.5, 0.7), ("poor", -1.0, 0.5))


def metrics(assignments: DataFrame) -> DataFrame:
    """A row a cycle: count, mean, median, sample deviation (0 for one), buckets."""
    c = F.col("confidence")
    buckets = [F.count_if((c >= lo) & (c < hi)).alias(name) for name, lo, hi in BUCKETS]
    return assignments.groupBy("cycle").agg(
        F.count(F.lit(1)).alias("n"), F.avg(c).alias("mean"), F.percentile(c, F.lit(0.5)).alias("median"), F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias("stdev"), F.min(c).alias("low"), F.max(c).alias("high"), *buckets
    )


def counted(assignments: DataFrame) -> DataFrame:
    """cycle, kind, value, n: counts by type and by category in one pass."""
    both = assignments.select("cycle", F.explode(F.array(F.struct(F.lit("type").alias("kind"), F.col("rel_type").alias("value")), F.struct(F.lit("category").alias("kind"), F.col("category").alias("value")))).alias("x"))
    return both.groupBy("cycle", "x.kind", "x.value").agg(F.count(F.lit(1)).alias("n"))


def extremes(assignments: DataFrame, top: int = 10, bottom: int = 5) -> DataFrame:
    """Best and worst assignments of all, in stable order."""
    best = assignments.orderBy(F.desc("confidence"), "seq").limit(top).withColumn("side", F.lit("top"))
    worst = assignments.orderBy("confidence", "seq").limit(bottom).withColumn("side", F.lit("bottom"))
    return best.unionByName(worst)


def changes(per_cycle: DataFrame, value: str) -> DataFrame:
    """Per cent against the cycle before, null where that was not positive. One row a cycle: a single window is small."""
    before = F.lag(value).over(Window.orderBy("cycle"))
    return per_cycle.select("cycle", F.col(value).cast("double").alias("value"), F.when(before > 0, (F.col(value) - before) / before * 100).alias("change_pct"))


def trend(first: Column, last: Column) -> Column:
    """Equality counts as decline."""
    return F.when(last > first, "improving").otherwise("declining")


def summary(per_cycle: DataFrame) -> DataFrame:
    """One row over all cycles: totals, first against last, consistency."""
    s = per_cycle.agg(
        F.count(F.lit(1)).alias("cycles"),
        F.sum("n").alias("total"),
        F.avg("mean").alias("mean_of_means"),
        F.coalesce(F.stddev_samp("mean"), F.lit(0.0)).alias("spread"),
        F.coalesce(F.stddev_samp("n"), F.lit(0.0)).alias("count_spread"),
        F.min_by("mean", "cycle").alias("first_mean"),
        F.max_by("mean", "cycle").alias("last_mean"),
    )
    steady = F.when(F.col("cycles") < 3, "too few").when(F.col("spread") < 0.05, "very consistent").when(F.col("spread") < 0.1, "consistent").otherwise("variable")
    volume = F.when(F.col("cycles") < 3, "too few").when(F.col("count_spread") < 50, "stable").when(F.col("count_spread") < 100, "moderate").otherwise("volatile")
    return s.withColumn("trend", trend(F.col("first_mean"), F.col("last_mean"))).withColumn("consistency", steady).withColumn("volume", volume).withColumn("cv_pct", F.when(F.col("mean_of_means") > 0, F.col("spread") / F.col("mean_of_means") * 100))


def latest_against_previous(per_cycle: DataFrame) -> DataFrame:
    w = Window.orderBy(F.desc("cycle"))
    two = per_cycle.withColumn("nth", F.row_number().over(w)).where("nth <= 2")
    one = lambda k, c: F.max(F.when(F.col("nth") == k, F.col(c)))
    return two.agg(one(1, "cycle").alias("latest"), one(2, "cycle").alias("previous"), (one(1, "n") - one(2, "n")).alias("n_change"), (one(1, "mean") - one(2, "mean")).alias("mean_change"))


def by_group(counts: DataFrame) -> DataFrame:
    """kind, value: average, total, and first-against-last trend of counts."""
    g = counts.groupBy("kind", "value").agg(F.avg("n").alias("average"), F.sum("n").alias("total"), F.min_by("n", "cycle").alias("first"), F.max_by("n", "cycle").alias("last"))
    return g.withColumn("trend", F.when(F.col("last") > F.col("first"), "increasing").otherwise("decreasing"))


def recommendations(summary_row: DataFrame) -> DataFrame:
    """Rules over the summary, each a row when it holds."""
    rules = F.array(
        F.when(F.col("mean_of_means") < 0.5, "raise the quality of candidates: mean confidence is low"),
        F.when(F.col("trend") == "declining", "look into the decline of mean confidence"),
        F.when(F.col("consistency") == "variable", "confidence varies between cycles: check the inputs"),
        F.when(F.col("volume") == "volatile", "the number of assignments varies: check the limits"),
    )
    return summary_row.select(F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("advice"))


def recent_pairs(assignments: DataFrame, cycles: int) -> DataFrame:
    """Distinct (source, target) of the last ``cycles`` cycles by number."""
    last = assignments.agg(F.max("cycle").alias("last"))
    return assignments.join(F.broadcast(last), F.col("cycle") > F.col("last") - cycles).select("source", "target").distinct()  # one row
