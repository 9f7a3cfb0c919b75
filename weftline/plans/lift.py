"""Maps the relational tables into nodes, edges, cycles and issues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import chars
from weftline.operators import tree


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, parent_path, is_dir: regions hold nations, which hold customers and suppliers."""
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    r = region.select("r_regionkey", F.concat(F.lit("/"), "r_name").alias("r_path"))
    n = nation.join(F.broadcast(r), nation["n_regionkey"] == r["r_regionkey"]).select("n_nationkey", F.concat("r_path", F.lit("/"), "n_name").alias("n_path"), "r_path")
    files = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nk"), F.col("c_name").alias("name"))
    files = files.unionByName(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nk"), F.col("s_name").alias("name")))
    leaf = files.join(F.broadcast(n), files["nk"] == n["n_nationkey"]).select(F.concat("n_path", F.lit("/"), "name").alias("path"), F.col("n_path").alias("parent_path"), F.lit(False).alias("is_dir"))
    top = r.select(F.col("r_path").alias("path"), F.lit(None).cast("string").alias("parent_path"), F.lit(True).alias("is_dir"))
    mid = n.select(F.col("n_path").alias("path"), F.col("r_path").alias("parent_path"), F.lit(True).alias("is_dir"))
    return top.unionByName(mid).unionByName(leaf)


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.assign_keys(paths(spark, sf_dir), levels=3)


NODES = """
r AS (SELECT r_regionkey, '/' || r_name AS path, '1' || chr(CAST(64 + row_number() OVER (ORDER BY r_name) AS INT)) AS key FROM region),
nn AS (SELECT n_nationkey, r.path || '/' || n_name AS path, r.path AS parent_path, r.key || chr(CAST(96 + row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS INT)) AS key
       FROM nation JOIN r ON n_regionkey = r_regionkey),
ff AS (SELECT c_nationkey AS nk, c_name AS name FROM customer UNION ALL SELECT s_nationkey, s_name FROM supplier),
nodes AS (
  SELECT key, path, CAST(NULL AS VARCHAR) AS parent_path, 1 AS tier, true AS is_dir FROM r
  UNION ALL SELECT key, path, parent_path, 1, true FROM nn
  UNION ALL SELECT nn.key || CAST(row_number() OVER (PARTITION BY nn.path ORDER BY ff.name) AS VARCHAR), nn.path || '/' || ff.name, nn.path, 1, false FROM ff JOIN nn ON ff.nk = nn.n_nationkey
)
"""


#: What edges between two regions say; each pair of regions has a tone of its own, so that no character wins everywhere.
TONES = ["nnss", "<<ds", ">>SS", "<>ss", "ssss", "ddSS", "xsss", "n<ss", "pSsn"]


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tracker, src, dst, ch, seq: suggestions between nations, with repeats and ties."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_quantity")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    n = table(spark, sf_dir, "nation")  # 25 rows
    c = table(spark, sf_dir, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_nationkey", F.col("n_regionkey").alias("c_region"))
    s = table(spark, sf_dir, "supplier").join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_nationkey", F.col("n_regionkey").alias("s_region"))
    joined = l.join(o, l["l_orderkey"] == o["o_orderkey"]).join(c, o["o_custkey"] == c["c_custkey"]).join(s, l["l_suppkey"] == s["s_suppkey"])
    tone = F.array(*map(F.lit, TONES))[(F.col("c_region") * 2 + F.col("s_region") * 3) % len(TONES)]
    ch = F.substr(tone, ((F.col("l_linenumber") + F.col("l_quantity").cast("int")) % 4 + 1).cast("int"), F.lit(1))
    return joined.where("c_nationkey <> s_nationkey").select(F.col("o_orderpriority").alias("tracker"), F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst"), ch.alias("ch"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"))


PRIO = "CASE {c} WHEN 'x' THEN 6 WHEN '<' THEN 5 WHEN '>' THEN 5 WHEN 'n' THEN 5 WHEN 'd' THEN 4 WHEN 'S' THEN 3 WHEN 's' THEN 2 WHEN 'p' THEN 1 WHEN 'o' THEN 1 ELSE 0 END"
EDGES = f"""
edges AS (
  SELECT o_orderpriority AS tracker, c_nationkey AS src, s_nationkey AS dst,
         substr(({TONES})[1 + (a.n_regionkey * 2 + b.n_regionkey * 3) % {len(TONES)}], CAST((l_linenumber + CAST(l_quantity AS INT)) % 4 + 1 AS INT), 1) AS ch,
         l_orderkey * 8 + l_linenumber AS seq
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation a ON a.n_nationkey = c_nationkey JOIN nation b ON b.n_nationkey = s_nationkey
  WHERE c_nationkey <> s_nationkey
)
"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tracker, src, dst, ch: one character for each pair of a tracker."""
    e = edges(spark, sf_dir)
    return e.groupBy("tracker", "src", "dst").agg(F.max_by("ch", F.struct(chars.priority(F.col("ch")), (F.col("ch") == "n"), F.col("ch"))).alias("ch"))


CELLS = EDGES + f""", cells AS (
  SELECT tracker, src, dst, arg_max(ch, {{'p': {PRIO.format(c='ch')}, 'n': ch = 'n', 'c': ch}}) AS ch FROM edges GROUP BY tracker, src, dst
)"""


def cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cycle, source, target, category, confidence: re-ranking assignments, one cycle a day."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.dayofmonth("ts").alias("cycle"),
        F.col("user_id").alias("source"),
        F.col("event_id").alias("target"),
        F.col("event_type").alias("rel_type"),
        F.when(F.col("user_id") % 3 == 0, "doc").otherwise("code").alias("category"),
        (F.col("value") / 500.0).alias("confidence"),
        F.col("event_id").alias("seq"),
    )


CYCLES = """
cycles AS (SELECT day(ts) AS cycle, user_id AS source, event_id AS target, event_type AS rel_type, CASE WHEN user_id % 3 = 0 THEN 'doc' ELSE 'code' END AS category, value / 500.0 AS confidence, event_id AS seq FROM events)
"""
