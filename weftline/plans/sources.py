"""Queries on connection maps, logs and trackers, written from the tables as their tools write them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import symbols
from weftline.plans import lift, links
from weftline.plans.registry import query
from weftline.sources import logs, sinks, trackers

def rails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, line, content: a line for each order, a rail for each of its suppliers, in text of other brackets."""
    l = lift.table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_suppkey").cast("string").alias("s"), F.col("l_partkey").cast("string").alias("p"), F.col("l_quantity").cast("int").cast("string").alias("q"))
    o = lift.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("path"))
    target = F.concat(F.lit("f"), "p", F.lit(".x:"), F.when(F.col("q").cast("int") % 3 == 0, "?").otherwise(F.col("q")))
    each = l.groupBy("l_orderkey", "s").agg(F.array_join(F.array_sort(F.collect_list(target)), "|").alias("targets"))
    rail = F.concat(F.lit("[g"), "s", F.lit(" -> 2A"), "s", F.lit("#1:"), "targets", F.lit("]"))
    said = each.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list(rail)), " [no rail] ").alias("rails"))
    joined = o.join(said, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.select("path", F.col("o_orderkey").cast("int").alias("line"), F.concat(F.lit("see [this] "), F.coalesce("rails", F.lit("-> none"))).alias("content"))


@query("""SELECT CAST(o_custkey AS VARCHAR) AS path, CAST(o_orderkey AS INT) AS line, 'g' || l_suppkey AS source_symbol, '2A' || l_suppkey || '#1' AS target_key, 'f' || l_partkey || '.x' AS target_symbol,
CASE WHEN CAST(l_quantity AS INT) % 3 <> 0 THEN CAST(l_quantity AS INT) END AS target_line FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def symbol_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.connection_edges(rails(spark, sf_dir))


@query("""SELECT 'g' || l_suppkey AS source_symbol, '2A' || l_suppkey || '#1' AS target_key, string_agg(DISTINCT t, '|' ORDER BY t) AS label
FROM (SELECT l_suppkey, 'f' || l_partkey || '.x:' || CASE WHEN CAST(l_quantity AS INT) % 3 = 0 THEN '?' ELSE CAST(CAST(l_quantity AS INT) AS VARCHAR) END AS t FROM lineitem JOIN orders ON l_orderkey = o_orderkey) GROUP BY l_suppkey""")
def symbol_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.connection_labels(symbols.connection_edges(rails(spark, sf_dir)))


@query("""
WITH a AS (SELECT p_brand AS path, p_partkey % 40 AS name, CASE WHEN min(p_size) % 2 = 0 THEN 's' || CAST(min(p_size) AS VARCHAR) END AS signature, min(p_size) AS line FROM part WHERE p_partkey % 3 <> 0 GROUP BY 1, 2),
b AS (SELECT p_brand AS path, p_partkey % 40 AS name, 't' || CAST(max(p_size) AS VARCHAR) AS signature, max(p_size) AS line FROM part WHERE p_partkey % 4 <> 0 GROUP BY 1, 2)
SELECT path, name, coalesce(a.signature, b.signature) AS signature, coalesce(a.line, b.line) AS line, CASE WHEN a.line IS NULL THEN 'ast' WHEN b.line IS NULL THEN 'runtime' ELSE 'both' END AS origin FROM a FULL JOIN b USING (path, name)
""")
def symbol_map_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = lift.table(spark, sf_dir, "part").select(F.col("p_brand").alias("path"), (F.col("p_partkey") % 40).alias("name"), "p_partkey", "p_size")
    a = p.where("p_partkey % 3 <> 0").groupBy("path", "name").agg(F.min("p_size").alias("line")).withColumn("signature", F.when(F.col("line") % 2 == 0, F.concat(F.lit("s"), F.col("line").cast("string"))))
    b = p.where("p_partkey % 4 <> 0").groupBy("path", "name").agg(F.max("p_size").alias("line")).withColumn("signature", F.concat(F.lit("t"), F.col("line").cast("string")))
    return symbols.merge_maps(a, b)


@query("""
WITH s AS (SELECT p_brand AS path, (CASE WHEN p_size % 3 = 0 THEN '_' ELSE '' END) || 'f' || CAST(p_partkey AS VARCHAR) AS name, CASE WHEN p_size % 2 = 0 THEN 'method' ELSE 'function' END AS kind, p_size % 5 = 0 AS is_stub, p_size % 7 = 0 AS annotated, p_size % 4 = 0 AS is_async, p_size % 3 = 1 AS exported, p_partkey FROM part),
u AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1), j AS (SELECT s.*, coalesce(u.n, 0) AS uses FROM s LEFT JOIN u ON u.l_partkey = s.p_partkey)
SELECT path, name, unnest(list_filter([CASE WHEN is_stub AND annotated THEN 'annotated stub' END, CASE WHEN is_stub AND exported THEN 'exported placeholder' END, CASE WHEN is_stub AND is_async THEN 'async stub' END, CASE WHEN is_stub AND kind = 'method' THEN 'concrete stub' END,
  CASE WHEN exported AND uses = 0 THEN 'orphan export' END, CASE WHEN NOT exported AND uses = 0 AND starts_with(name, '_') THEN 'dead code' END], lambda x: x IS NOT NULL)) AS finding FROM j
""")
def runtime_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, size = lift.table(spark, sf_dir, "part"), F.col("p_size")
    name = F.concat(F.when(size % 3 == 0, "_").otherwise(""), F.lit("f"), F.col("p_partkey").cast("string"))
    s = p.select(F.col("p_brand").alias("path"), name.alias("name"), F.when(size % 2 == 0, "method").otherwise("function").alias("kind"), (size % 5 == 0).alias("is_stub"), (size % 7 == 0).alias("annotated"), (size % 4 == 0).alias("is_async"), (size % 3 == 1).alias("exported"))
    l = lift.table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey")
    refs = l.join(p.select("p_partkey", name.alias("name")), F.col("l_partkey") == F.col("p_partkey")).select("name", F.col("l_suppkey").cast("string").alias("path"))
    return symbols.runtime_findings(s, refs)


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """value: what a run logs of each event, in both of its forms, between lines that say nothing."""
    e = lift.table(spark, sf_dir, "events")
    user, event, share = (F.col("user_id").cast("string"), F.col("event_id").cast("string"), (F.col("event_id") % 100).cast("int"))
    score = F.concat(F.lit("0."), F.lpad(share.cast("string"), 2, "0"))
    first = F.concat(F.lit("Suggesting '<' from C:/p/u"), user, F.lit(".py to /p/e"), event, F.lit(".py (confidence: "), score, F.lit(")"))
    second = F.concat(F.lit("/p/u"), user, F.lit(".md -> /p/e"), event, F.lit(".py [d] score="), score)
    return e.select(F.when(F.col("event_id") % 3 == 0, first).when(F.col("event_id") % 3 == 1, second).otherwise(F.concat(F.lit("nothing of "), event)).alias("value"))


@query("""SELECT CASE WHEN event_id % 3 = 0 THEN 'C:/p/u' || user_id || '.py' ELSE '/p/u' || user_id || '.md' END AS source, '/p/e' || event_id || '.py' AS target, CASE WHEN event_id % 3 = 0 THEN '<' ELSE 'd' END AS ch, CAST('0.' || lpad(CAST(event_id % 100 AS VARCHAR), 2, '0') AS DOUBLE) AS confidence
FROM events WHERE event_id % 3 < 2""")
def log_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.suggestions(log_lines(spark, sf_dir))


def scan_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """value: a JSON record for each event; some were cut before their end, some lack a field, some are no JSON."""
    e = lift.table(spark, sf_dir, "events")
    event = F.col("event_id").cast("string")
    whole = F.concat(F.lit('{"source": "/u'), F.col("user_id").cast("string"), F.lit('", "target": "/e'), event, F.lit('", "confidence": 0.'), F.lpad((F.col("event_id") % 100).cast("string"), 2, "0"), F.lit(', "cycle": '), F.dayofmonth("ts").cast("string"))
    kind = F.col("event_id") % 4
    return e.select(F.when(kind == 0, F.concat(whole, F.lit("}"))).when(kind == 1, whole).when(kind == 2, F.concat(F.lit("garbage "), event)).otherwise(F.lit('{"source": "/a"}')).alias("value"))


@query("""SELECT CASE WHEN k < 2 THEN '/u' || user_id END AS source, CASE WHEN k < 2 THEN '/e' || event_id END AS target, CASE WHEN k < 2 THEN CAST('0.' || lpad(CAST(event_id % 100 AS VARCHAR), 2, '0') AS DOUBLE) END AS confidence,
CASE WHEN k < 2 THEN CAST(day(ts) AS INT) END AS cycle, (['ok', 'repaired', 'skipped', 'skipped'])[1 + k] AS state FROM (SELECT *, event_id % 4 AS k FROM events)""")
def log_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.scans(scan_lines(spark, sf_dir))


@query(f"WITH {links.GRID} SELECT tracker, CAST(src AS VARCHAR) AS src, CAST(dst AS VARCHAR) AS dst, ch FROM full_grid WHERE src <> dst AND src > 0")
def tracker_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grids written as tracker documents and read back as edges; keys start at 1."""
    rows = links.grid_rows(spark, sf_dir).select("tracker", F.col("key").cast("string").alias("key"), "row")
    keys = links.tracker_keys(spark, sf_dir).select("tracker", F.col("key").alias("ord"), F.col("key").cast("string").alias("key"), F.concat(F.lit("/n/"), F.col("key").cast("string")).alias("path"))
    docs = sinks.tracker_text(keys, rows, "2024-01-01")
    return trackers.cells(docs).where("src <> '0'")
