"""Queries on embeddings and on cycles of assignments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import chars
from weftline.operators import history, similarity
from weftline.plans import lift
from weftline.plans.lift import CYCLES
from weftline.plans.registry import query

#: 0.35 of the lower similarity threshold, the pre-filter of candidates.
PRE = 0.2275
PAIRS = f"""
v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings),
pairs AS (SELECT x.vec_id AS a, y.vec_id AS b, greatest(0.0, least(1.0, list_dot_product(x.e, y.e))) AS score, x.label AS la, y.label AS lb FROM v x JOIN v y ON x.vec_id < y.vec_id WHERE list_dot_product(x.e, y.e) >= {PRE})
"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lift.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.when(F.col("label") % 3 == 0, "doc").otherwise("code").alias("role"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.cosine_pairs(vectors(spark, sf_dir), PRE)


@query(f"WITH {PAIRS} SELECT a, b, round(score, 6) AS score FROM pairs")
def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).withColumn("score", F.round("score", 10))


ROLE = "CASE WHEN {c} % 3 = 0 THEN 'doc' ELSE 'code' END"


@query(f"""
WITH {PAIRS}, r AS (SELECT a, b, score, {ROLE.format(c='la')} AS ra, {ROLE.format(c='lb')} AS rb FROM pairs)
SELECT a, b, CASE WHEN score >= 0.45 THEN CASE WHEN ra = 'doc' AND rb = 'code' THEN '>' WHEN ra = 'code' AND rb = 'doc' THEN '<' ELSE 'x' END WHEN score >= 0.40 THEN 'S' ELSE 's' END AS ch FROM r WHERE score >= 0.30
""")
def cosine_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters that similarities earn, with bands that these vectors reach."""
    found = similarity.cosine_pairs(vectors(spark, sf_dir), 0.30, carried="role")  # the lowest band; the pre-filter lies below it
    return found.select("a", "b", chars.band(F.col("score"), F.col("a_role"), F.col("b_role"), 0.45, 0.40, 0.30).alias("ch")).where("ch IS NOT NULL")


TOP = """
d AS (SELECT a AS src, b AS dst, score FROM pairs UNION ALL SELECT b, a, score FROM pairs),
top AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS rank FROM d QUALIFY rank <= 10)
"""


@query(f"WITH {PAIRS}, {TOP} SELECT src, dst, CAST(rank AS INT) AS rank FROM top")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.cosine_top(vectors(spark, sf_dir), PRE, 10).select("src", "dst", "rank")


@query(f"WITH {PAIRS}, {TOP}, n AS (SELECT src, sum(count(*)) OVER (ORDER BY src) AS upto FROM top GROUP BY src) SELECT src, dst, CAST(rank AS INT) AS rank FROM top WHERE src IN (SELECT src FROM n WHERE upto <= 1500)")
def cosine_topk_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top candidates under one budget for all sources."""
    return similarity.cosine_top_budget(vectors(spark, sf_dir), PRE, 10, budget=1500).select("src", "dst", "rank")


@query(f"""
WITH {PAIRS}, known AS (SELECT DISTINCT o_custkey % 500 AS src, o_orderkey % 500 AS dst FROM orders WHERE o_orderpriority = '1-URGENT'), past AS (SELECT DISTINCT user_id % 500 AS src, event_id % 500 AS dst FROM events WHERE day(ts) > 20)
SELECT a, b, round(score, 6) AS score FROM pairs WHERE NOT EXISTS (SELECT 1 FROM known k WHERE least(k.src, k.dst) = a AND greatest(k.src, k.dst) = b) AND NOT EXISTS (SELECT 1 FROM past k WHERE least(k.src, k.dst) = a AND greatest(k.src, k.dst) = b)
""")
def rerank_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates without verified and without recently scored pairs, either way round."""
    known = lift.table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select((F.col("o_custkey") % 500).alias("src"), (F.col("o_orderkey") % 500).alias("dst"))
    past = lift.table(spark, sf_dir, "events").where(F.dayofmonth("ts") > 20).select((F.col("user_id") % 500).alias("src"), (F.col("event_id") % 500).alias("dst"))
    left = similarity.cosine_pairs(vectors(spark, sf_dir), PRE, excluded=known.unionByName(past))
    return left.withColumn("score", F.round("score", 10))


METRICS = f"""
{CYCLES}, m AS (SELECT cycle, count(*) AS n, avg(confidence) AS mean, median(confidence) AS median, coalesce(stddev_samp(confidence), 0) AS stdev, min(confidence) AS low, max(confidence) AS high,
  count(*) FILTER (confidence >= 0.9 AND confidence < 2) AS excellent, count(*) FILTER (confidence >= 0.7 AND confidence < 0.9) AS good, count(*) FILTER (confidence >= 0.5 AND confidence < 0.7) AS fair, count(*) FILTER (confidence < 0.5) AS poor FROM cycles GROUP BY cycle)
"""


def per_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.metrics(lift.cycles(spark, sf_dir))


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 10) for c in cols})


@query(f"WITH {METRICS} SELECT cycle, n, round(mean, 10) AS mean, round(median, 10) AS median, round(stdev, 10) AS stdev, round(low, 10) AS low, round(high, 10) AS high, excellent, good, fair, poor FROM m")
def cycle_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(per_cycle(spark, sf_dir), "mean", "median", "stdev", "low", "high")


@query(f"WITH {CYCLES} SELECT cycle, 'type' AS kind, rel_type AS value, count(*) AS n FROM cycles GROUP BY ALL UNION ALL SELECT cycle, 'category', category, count(*) FROM cycles GROUP BY ALL")
def cycle_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.counted(lift.cycles(spark, sf_dir))


@query(f"WITH {METRICS}, l AS (SELECT cycle, mean AS value, lag(mean) OVER (ORDER BY cycle) AS before FROM m) SELECT cycle, round(value, 10) AS value, round(CASE WHEN before > 0 THEN (value - before) / before * 100 END, 8) AS change_pct FROM l")
def cycle_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.changes(per_cycle(spark, sf_dir), "mean").select("cycle", F.round("value", 10).alias("value"), F.round("change_pct", 8).alias("change_pct"))


SUMMARY = f"""
{METRICS}, s AS (SELECT count(*) AS cycles, CAST(sum(n) AS BIGINT) AS total, avg(mean) AS mean_of_means, coalesce(stddev_samp(mean), 0) AS spread, coalesce(stddev_samp(n), 0) AS count_spread, arg_min(mean, cycle) AS first_mean, arg_max(mean, cycle) AS last_mean FROM m),
su AS (SELECT *, CASE WHEN last_mean > first_mean THEN 'improving' ELSE 'declining' END AS trend,
  CASE WHEN cycles < 3 THEN 'too few' WHEN spread < 0.05 THEN 'very consistent' WHEN spread < 0.1 THEN 'consistent' ELSE 'variable' END AS consistency,
  CASE WHEN cycles < 3 THEN 'too few' WHEN count_spread < 50 THEN 'stable' WHEN count_spread < 100 THEN 'moderate' ELSE 'volatile' END AS volume, CASE WHEN mean_of_means > 0 THEN spread / mean_of_means * 100 END AS cv_pct FROM s)
"""


@query(f"WITH {SUMMARY} SELECT cycles, total, round(mean_of_means, 10) AS mean_of_means, round(spread, 10) AS spread, round(count_spread, 8) AS count_spread, round(first_mean, 10) AS first_mean, round(last_mean, 10) AS last_mean, trend, consistency, volume, round(cv_pct, 8) AS cv_pct FROM su")
def cycle_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = rounded(history.summary(per_cycle(spark, sf_dir)), "mean_of_means", "spread", "first_mean", "last_mean")
    return s.withColumns({"count_spread": F.round("count_spread", 8), "cv_pct": F.round("cv_pct", 8)})


@query(f"""
WITH {SUMMARY} SELECT unnest(list_filter([CASE WHEN mean_of_means < 0.5 THEN 'raise the quality of candidates: mean confidence is low' END, CASE WHEN trend = 'declining' THEN 'look into the decline of mean confidence' END,
  CASE WHEN consistency = 'variable' THEN 'confidence varies between cycles: check the inputs' END, CASE WHEN volume = 'volatile' THEN 'the number of assignments varies: check the limits' END], lambda x: x IS NOT NULL)) AS advice FROM su
""")
def cycle_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.recommendations(history.summary(per_cycle(spark, sf_dir)))


@query(f"WITH {METRICS}, r AS (SELECT *, row_number() OVER (ORDER BY cycle DESC) AS nth FROM m) SELECT a.cycle AS latest, b.cycle AS previous, a.n - b.n AS n_change, round(a.mean - b.mean, 10) AS mean_change FROM r a JOIN r b ON a.nth = 1 AND b.nth = 2")
def cycle_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(history.latest_against_previous(per_cycle(spark, sf_dir)), "mean_change")


@query(f"""
WITH {CYCLES}, c AS (SELECT cycle, 'type' AS kind, rel_type AS value, count(*) AS n FROM cycles GROUP BY ALL UNION ALL SELECT cycle, 'category', category, count(*) FROM cycles GROUP BY ALL),
g AS (SELECT kind, value, round(avg(n), 10) AS average, CAST(sum(n) AS BIGINT) AS total, arg_min(n, cycle) AS first, arg_max(n, cycle) AS last FROM c GROUP BY ALL)
SELECT *, CASE WHEN last > first THEN 'increasing' ELSE 'decreasing' END AS trend FROM g
""")
def cycle_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(history.by_group(history.counted(lift.cycles(spark, sf_dir))), "average")


@query(f"WITH {CYCLES} SELECT DISTINCT source, target FROM cycles WHERE cycle > (SELECT max(cycle) FROM cycles) - 10")
def historical_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.recent_pairs(lift.cycles(spark, sf_dir), 10)


@query(f"""
WITH {CYCLES} SELECT * FROM (SELECT 'top' AS side, source, target, round(confidence, 10) AS confidence FROM cycles ORDER BY cycles.confidence DESC, seq LIMIT 10)
UNION ALL SELECT * FROM (SELECT 'bottom', source, target, round(confidence, 10) FROM cycles ORDER BY cycles.confidence, seq LIMIT 5)
""")
def top_bottom_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(history.extremes(lift.cycles(spark, sf_dir)), "confidence").select("side", "source", "target", "confidence")
