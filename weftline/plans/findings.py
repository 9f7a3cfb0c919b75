"""Queries on symbols, issues, context packages and diagrams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import context, diagram, issues
from weftline.plans import lift
from weftline.plans.lift import CELLS
from weftline.plans.registry import query

#: Lines of an order are symbols that lie one after another and inside wider ones; every line holds an issue.
RANGES = """
ranges AS (SELECT l_orderkey AS file, 'f' || CAST(l_linenumber AS VARCHAR) AS symbol, CAST(1 + 60 * (l_linenumber - 1) AS INT) AS start, CAST(1 + 60 * (l_linenumber - 1) + l_quantity AS INT) AS stop FROM lineitem
 UNION ALL SELECT l_orderkey, 'c' || CAST(l_linenumber AS VARCHAR), CAST(1 + 60 * (l_linenumber - 1) AS INT), CAST(60 * (l_linenumber + 1) AS INT) FROM lineitem WHERE l_linenumber % 2 = 1),
issues AS (SELECT DISTINCT l_orderkey * 8 + l_linenumber AS issue, l_orderkey AS file, CAST(1 + (l_partkey * 13) % 420 AS INT) AS line, CASE l_linenumber % 4 WHEN 0 THEN 'Empty/Stub Function' WHEN 1 THEN 'Concrete Stub Method' WHEN 2 THEN 'NotImplementedError' ELSE 'placeholder' END AS subtype, l_returnflag = 'R' AS exported, l_suppkey % 5 AS context_size FROM lineitem)
"""


def ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = lift.table(spark, sf_dir, "lineitem")
    start = (1 + 60 * (F.col("l_linenumber") - 1)).cast("int")
    inner = l.select(F.col("l_orderkey").alias("file"), F.concat(F.lit("f"), F.col("l_linenumber").cast("string")).alias("symbol"), start.alias("start"), (start + F.col("l_quantity")).cast("int").alias("stop"))
    outer = l.where("l_linenumber % 2 = 1").select(F.col("l_orderkey").alias("file"), F.concat(F.lit("c"), F.col("l_linenumber").cast("string")).alias("symbol"), start.alias("start"), (60 * (F.col("l_linenumber") + 1)).cast("int").alias("stop"))
    return inner.unionByName(outer)


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_linenumber") % 4
    return lift.table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("issue"),
        F.col("l_orderkey").alias("file"),
        (1 + (F.col("l_partkey") * 13) % 420).cast("int").alias("line"),
        F.when(k == 0, "Empty/Stub Function").when(k == 1, "Concrete Stub Method").when(k == 2, "NotImplementedError").otherwise("placeholder").alias("subtype"),
        (F.col("l_returnflag") == "R").alias("exported"),
        (F.col("l_suppkey") % 5).alias("context_size"),
    ).distinct()


ENCLOSED = f"""
{RANGES}, enclosed AS (SELECT i.issue, i.file, i.line, i.subtype, i.exported, i.context_size, arg_min(r.symbol, {{'s': r.stop - r.start, 'a': r.start, 'n': r.symbol}}) AS symbol
 FROM issues i LEFT JOIN ranges r ON r.file = i.file AND i.line BETWEEN r.start AND r.stop GROUP BY ALL)
"""


@query(f"WITH {ENCLOSED} SELECT issue, file, line, symbol FROM enclosed")
def smallest_enclosing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return issues.smallest_enclosing(found(spark, sf_dir).select("issue", "file", "line"), ranges(spark, sf_dir))


REFS = """
refs AS (SELECT DISTINCT p_brand AS name, l_suppkey AS file FROM lineitem JOIN part ON l_partkey = p_partkey), names AS (SELECT DISTINCT p_brand AS name, CAST(p_size % 10 AS BIGINT) AS file FROM part)
"""


@query(f"WITH {REFS}, j AS (SELECT n.name, n.file, r.file AS caller, row_number() OVER (PARTITION BY n.name, n.file ORDER BY r.file) AS nth FROM names n LEFT JOIN refs r ON r.name = n.name AND r.file <> n.file) SELECT name, file, count(caller) AS n_callers, string_agg(CASE WHEN nth <= 20 THEN CAST(caller AS VARCHAR) END, ',' ORDER BY caller) AS callers FROM j GROUP BY 1, 2")
def callers_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that refer to a name, other than its own; the list shows twenty."""
    p = lift.table(spark, sf_dir, "part")
    l = lift.table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey")
    refs = l.join(p.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_brand").alias("name"), F.col("l_suppkey").alias("file"))
    names = p.select(F.col("p_brand").alias("name"), (F.col("p_size") % 10).cast("long").alias("file")).distinct()
    out = issues.callers(names, refs)
    return out.withColumn("callers", F.array_join(F.transform("callers", lambda x: x.cast("string")), ","))


ENRICHED = f"""
{ENCLOSED}, n AS (SELECT l_orderkey AS file, count(DISTINCT l_suppkey) AS callers FROM lineitem GROUP BY 1),
enriched AS (SELECT e.*, CASE WHEN contains(subtype, 'NotImplementedError') OR subtype IN ('Annotated Stub', 'Exported Placeholder', 'Concrete Stub Method') THEN 2 WHEN subtype IN ('Empty/Stub Function', 'Empty/Stub Class', 'Async Stub') THEN 1 ELSE 0 END + CASE WHEN n.callers > 0 THEN 1 ELSE 0 END + CASE WHEN exported THEN 1 ELSE 0 END AS points FROM enclosed e JOIN n USING (file)),
shown AS (SELECT *, CASE WHEN points >= 4 THEN 'critical' WHEN points >= 2 THEN 'high' WHEN points >= 1 THEN 'medium' ELSE 'low' END AS severity FROM enriched WHERE NOT (coalesce(symbol, '') LIKE 'c%' AND subtype = 'Empty/Stub Function' AND file % 10 = 0))
"""


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues with their symbol, points and severity; stubs of containers in test files are suppressed."""
    i = issues.smallest_enclosing(found(spark, sf_dir), ranges(spark, sf_dir))
    n = lift.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("n_file")).agg(F.countDistinct("l_suppkey").alias("callers"))
    e = i.join(n, i["file"] == n["n_file"]).drop("n_file").withColumn("points", issues.points(F.col("subtype"), F.col("callers"), F.col("exported")))
    test = F.coalesce(F.col("symbol"), F.lit("")).startswith("c") & (F.col("file") % 10 == 0)
    return e.withColumn("severity", issues.severity(F.col("points"))).where(~issues.suppressed(F.col("subtype"), F.coalesce("symbol", F.lit("")), test, F.lit(False)))


@query(f"WITH {ENRICHED} SELECT issue, file, line, subtype, symbol, CAST(points AS INT) AS points, severity FROM shown")
def issue_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enriched(spark, sf_dir).select("issue", "file", "line", "subtype", "symbol", F.col("points").cast("int").alias("points"), "severity")


@query(f"WITH {RANGES}, k AS (SELECT file % 100 AS file, line % 20 AS line, subtype, issue, context_size FROM issues) SELECT file, line, subtype, arg_max(issue, {{'c': context_size, 'i': -issue}}) AS issue, max(context_size) AS context_size FROM k GROUP BY 1, 2, 3")
def issue_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = found(spark, sf_dir).withColumns({"file": F.col("file") % 100, "line": F.col("line") % 20})
    return issues.dedupe(k)


@query(f"WITH {ENRICHED}, k AS (SELECT severity, subtype, CASE WHEN file % 3 = 0 THEN 'Core Engine' ELSE 'Web Ui' END AS component, file FROM shown) SELECT severity, subtype, component, file, count(*) AS n FROM k GROUP BY GROUPING SETS ((severity), (subtype), (component), (file), ())")
def issue_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.when(F.col("file") % 3 == 0, "core_engine/a.py").otherwise("web-ui/b.py")
    return issues.rollups(enriched(spark, sf_dir).withColumn("component", issues.component(path)))


@query(f"WITH {ENRICHED} SELECT severity, file, line, issue, row_number() OVER (ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, file, line, issue) AS nth FROM shown QUALIFY nth <= 100")
def issue_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred issues to look at first."""
    from pyspark.sql import Window

    e = enriched(spark, sf_dir)
    rank = F.coalesce(*[F.when(F.col("severity") == s, r) for s, r in issues.SEVERITY_RANK.items()], F.lit(9))
    top = e.withColumn("rank", rank).orderBy("rank", "file", "line", "issue").limit(100)
    return top.withColumn("nth", F.row_number().over(Window.orderBy("rank", "file", "line", "issue")).cast("long")).select("severity", "file", "line", "issue", "nth")


@query("SELECT user_id AS file, event_type AS call, count(*) AS n, string_agg(DISTINCT CAST(day(ts) AS VARCHAR), ',' ORDER BY CAST(day(ts) AS VARCHAR)) AS lines FROM events GROUP BY 1, 2")
def call_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of each file, folded: how often, and on which lines."""
    lines = F.array_join(F.array_sort(F.collect_set(F.dayofmonth("ts").cast("string"))), ",")
    return lift.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("file"), F.col("event_type").alias("call")).agg(F.count(F.lit(1)).alias("n"), lines.alias("lines"))


@query("SELECT l_partkey AS src, l_suppkey AS dst, CASE WHEN l_linestatus = 'O' THEN '<' ELSE '>' END AS ch, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS reasons FROM lineitem GROUP BY 1, 2, 3")
def ast_links_consolidated(spark: SparkSession, sf_dir: str) -> DataFrame:
    ch = F.when(F.col("l_linestatus") == "O", "<").otherwise(">")
    l = lift.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), ch.alias("ch"), "l_returnflag")
    return l.groupBy("src", "dst", "ch").agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("reasons"))


TIER = "CASE ch WHEN 'x' THEN 1 WHEN '<' THEN 2 WHEN '>' THEN 2 WHEN 'd' THEN 3 WHEN 'S' THEN 4 WHEN 's' THEN 5 END"


@query(f"""
WITH {CELLS}, dep AS (SELECT src AS target, dst, min({TIER}) AS tier FROM cells WHERE {TIER} IS NOT NULL GROUP BY 1, 2), tok AS (SELECT CAST(p_partkey % 25 AS INT) AS node, CAST(sum(p_size) AS BIGINT) AS size FROM part GROUP BY 1),
e AS (SELECT dep.target, dep.dst, dep.tier, t.size, o.size AS own FROM dep JOIN tok t ON t.node = dep.dst JOIN tok o ON o.node = dep.target WHERE dep.dst % 5 <> 4),
u AS (SELECT *, CAST(sum(size) OVER (PARTITION BY target ORDER BY tier, size, dst ROWS UNBOUNDED PRECEDING) AS BIGINT) + own AS used FROM e)
SELECT target, dst, CAST(tier AS INT) AS tier, size, used FROM u WHERE used <= 16000
""")
def context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = lift.cells(spark, sf_dir).select(F.col("src").alias("target"), "dst", "ch")
    tokens = lift.table(spark, sf_dir, "part").groupBy((F.col("p_partkey") % 25).cast("int").alias("node")).agg(F.sum("p_size").alias("full_tokens"))
    referenced = links.where("dst % 5 <> 4").select("dst")
    return context.package(links, tokens, referenced, 16_000)


CANON = f"""
{CELLS}, lk AS (SELECT src, dst, ch FROM cells WHERE tracker = '1-URGENT'), e AS (SELECT CASE WHEN ch = '>' THEN dst ELSE src END AS src, CASE WHEN ch = '>' THEN src ELSE dst END AS dst, CASE WHEN ch = '>' THEN '<' ELSE ch END AS ch FROM lk),
g AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, bool_or(ch = 'x') AS x, bool_or(ch = '<' AND src < dst) AS ab, bool_or(ch = '<' AND src > dst) AS ba, max(CASE WHEN ch NOT IN ('x', '<') THEN ch END) AS other FROM e GROUP BY 1, 2),
canon AS (SELECT CASE WHEN NOT (x OR (ab AND ba)) AND ba THEN b ELSE a END AS src, CASE WHEN NOT (x OR (ab AND ba)) AND ba THEN a ELSE b END AS dst, CASE WHEN x OR (ab AND ba) THEN 'x' WHEN ab OR ba THEN '<' ELSE other END AS ch FROM g),
vis AS (SELECT src, dst, ch FROM canon WHERE ch NOT IN ('p', 's', 'o', '.', 'n') AND NOT (ch = 'x' AND (src // 2 = dst OR dst // 2 = src)) AND (src % 2 = dst % 2 OR ch = 'd'))
"""


def drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = lift.cells(spark, sf_dir).where("tracker = '1-URGENT'").select("src", "dst", "ch")
    k = F.col("n_nationkey")
    nodes = lift.table(spark, sf_dir, "nation").select(k.alias("node"), F.floor(k / 2).cast("int").alias("parent"), (k % 2 == 0).alias("is_dir"))
    return diagram.visible(diagram.canonical(links), nodes)


@query(f"WITH {CANON} SELECT src, dst, ch FROM vis")
def diagram_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drawn(spark, sf_dir)


@query(f"WITH {CANON} SELECT dst, ch, count(DISTINCT src) AS sources, round(least(2 + 4 * log2(count(DISTINCT src)), 18), 6) AS width FROM vis GROUP BY 1, 2 HAVING count(DISTINCT src) >= 3")
def diagram_pipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagram.pipes(drawn(spark, sf_dir)).withColumn("width", F.round("width", 6))


@query(f"""WITH {CANON} SELECT 'flowchart LR' || chr(10) || string_agg('  n' || src || CASE ch WHEN 'x' THEN ' <--> ' WHEN '<' THEN ' --> ' WHEN 'd' THEN ' -.-> ' WHEN 'S' THEN ' ==> ' ELSE ' --- ' END || 'n' || dst, chr(10) ORDER BY src, dst) AS text FROM vis""")
def mermaid_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagram.mermaid(drawn(spark, sf_dir))
