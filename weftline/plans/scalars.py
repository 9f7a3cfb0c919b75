"""Queries on the smaller scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import scalars, text
from weftline.plans import lift
from weftline.plans.registry import query
from weftline.sources import files


@query("SELECT DISTINCT least(CAST(c_custkey % 50 AS VARCHAR), CAST(c_nationkey AS VARCHAR)) || ':' || greatest(CAST(c_custkey % 50 AS VARCHAR), CAST(c_nationkey AS VARCHAR)) AS key FROM customer")
def similarity_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (F.col("c_custkey") % 50).cast("string"), F.col("c_nationkey").cast("string")
    return lift.table(spark, sf_dir, "customer").select(scalars.similarity_key(a, b).alias("key")).distinct()


@query("""
WITH g AS (SELECT p_brand, string_agg(DISTINCT p_type, chr(10) ORDER BY p_type) AS c FROM part GROUP BY 1)
SELECT p_brand, substr(sha256(md5(p_brand) || '|' || md5(c) || '|10|src|rank'), 1, 16) AS key FROM g
""")
def rerank_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = lift.table(spark, sf_dir, "part").groupBy("p_brand").agg(F.collect_set("p_type").alias("c"))
    return g.select("p_brand", scalars.rerank_key(F.col("p_brand"), F.col("c"), 10, F.lit("src"), F.lit("rank")).alias("key"))


@query("SELECT p_partkey, CAST(greatest(1, least(50, floor((p_size / 4.0 - greatest(0.5, p_size / 4.0 * 0.1)) / ((30 + p_retailprice / 1000 * 120) / 1024)))) AS INT) AS size FROM part")
def batch_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lift.table(spark, sf_dir, "part").select("p_partkey", scalars.batch_size(F.col("p_size") / F.lit(4.0), F.col("p_retailprice")).alias("size"))


@query("SELECT n_name, lower(n_name) AS plain, sha1('blob ' || CAST(length(n_name) AS VARCHAR) || chr(0) || n_name) AS sha FROM nation")
def blob_shas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What version control calls each name, and the name as an identifier of SQL would be read."""
    return lift.table(spark, sf_dir, "nation").select("n_name", text.sql_name(F.concat(F.lit('main."'), "n_name", F.lit('"'))).alias("plain"), text.blob_sha(F.col("n_name")).alias("sha"))


@query("""
WITH k AS (SELECT regexp_replace(p_type, '[^A-Za-z0-9_]', '_', 'g') AS id, p_partkey FROM part)
SELECT p_partkey, CASE WHEN nth = 1 THEN id ELSE id || '_' || CAST(nth AS VARCHAR) END AS safe FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p_partkey) AS nth FROM k)
""")
def safe_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = lift.table(spark, sf_dir, "part").select("p_partkey", scalars.safe_id(F.col("p_type")).alias("id"))
    nth = F.row_number().over(Window.partitionBy("id").orderBy("p_partkey"))
    return k.withColumn("nth", nth).select("p_partkey", F.when(F.col("nth") == 1, F.col("id")).otherwise(F.concat_ws("_", "id", F.col("nth").cast("string"))).alias("safe"))


@query("SELECT a.n_name AS a, b.n_name AS b, CASE WHEN a.n_regionkey = b.n_regionkey THEN '/r' || CAST(a.n_regionkey AS VARCHAR) ELSE '' END AS prefix FROM nation a JOIN nation b ON b.n_nationkey = a.n_nationkey + 1")
def common_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("/r"), F.col("n_regionkey").cast("string"), F.lit("/"), "n_name")
    n = lift.table(spark, sf_dir, "nation").select("n_nationkey", "n_name", path.alias("path"))
    b = n.select((F.col("n_nationkey") - 1).alias("n_nationkey"), F.col("n_name").alias("b"), F.col("path").alias("path_b"))
    return n.join(b, "n_nationkey").select(F.col("n_name").alias("a"), "b", scalars.common_prefix(F.col("path"), F.col("path_b")).alias("prefix"))


@query("SELECT event_type AS name, event_type <> 'purchase' AS useful, count(*) AS n FROM events GROUP BY 1, 2")
def useful_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of general names (here one event type, renamed) lead nowhere."""
    name = F.when(F.col("event_type") == "purchase", "obj.append").otherwise(F.col("event_type"))
    return lift.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("name"), scalars.useful_call(name).alias("useful")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT n_nationkey + 1 AS n, CASE WHEN n_nationkey = 0 THEN '#60a5fa' WHEN n_nationkey = 7 THEN '#facc15' END AS colour FROM nation WHERE n_nationkey IN (0, 7)")
def pipe_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lift.table(spark, sf_dir, "nation").where("n_nationkey IN (0, 7)").select((F.col("n_nationkey") + 1).alias("n"), scalars.pipe_colour(F.col("n_nationkey") + 1).alias("colour"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_without_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects that got comments and a comma too many are still read."""
    messy = F.concat(F.lit("// head\n"), F.regexp_replace("props", "}", ', /* "k": 0 */ "url": "http://x", }'))
    return lift.table(spark, sf_dir, "events").select("event_id", F.get_json_object(files.strip_json_comments(messy), "$.k").cast("long").alias("k"))


@query("SELECT event_type AS cache, count(*) AS lookups, count(*) FILTER (value > 100) AS hits, round(count(*) FILTER (value > 100) * 100.0 / count(*), 4) AS hit_rate FROM events GROUP BY 1")
def cache_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = lift.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("cache")).agg(F.count(F.lit(1)).alias("lookups"), F.count_if(F.col("value") > 100).alias("hits"))
    return e.withColumn("hit_rate", F.round(F.col("hits") * 100.0 / F.col("lookups"), 4))


@query("SELECT CASE WHEN s_acctbal < 0 THEN 'error' WHEN s_acctbal < 1000 THEN 'warning' ELSE 'ok' END AS category, count(*) AS n FROM supplier GROUP BY 1")
def map_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.when(F.col("s_acctbal") < 0, "error").when(F.col("s_acctbal") < 1000, "warning").otherwise("ok")
    return lift.table(spark, sf_dir, "supplier").groupBy(c.alias("category")).agg(F.count(F.lit(1)).alias("n"))
