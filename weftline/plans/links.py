"""Queries on typed edges: merges, roll-ups, grids, lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import chars, codec
from weftline.operators import grid, merge, tree
from weftline.plans import lift
from weftline.plans.lift import CELLS, EDGES, NODES, PRIO
from weftline.plans.registry import query


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lift.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_regionkey").alias("module"))


def tracker_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tracker knows all nations."""
    t = lift.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("tracker")).distinct()
    return t.join(F.broadcast(nations(spark, sf_dir).select("key")))  # 25 keys


def one(cells: DataFrame, tracker: str) -> DataFrame:
    return cells.where(F.col("tracker") == tracker)


@query(f"""
WITH {CELLS}, b AS (SELECT src, dst, arg_max(ch, {{'p': {PRIO.format(c='ch')}, 'n': ch = 'n', 't': tracker}}) AS ch FROM cells GROUP BY 1, 2)
SELECT b.src, b.dst, b.ch, string_agg(c.tracker, '|' ORDER BY c.tracker) AS origins FROM b JOIN cells c ON c.src = b.src AND c.dst = b.dst AND c.ch = b.ch GROUP BY ALL
""")
def links_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: every tracker's cells merged into links with their origins."""
    return merge.across_trackers(lift.cells(spark, sf_dir)).select("src", "dst", "ch", F.array_join("origins", "|").alias("origins"))


@query(f"""
WITH {EDGES}, a AS (SELECT src, dst, max({PRIO.format(c='ch')}) AS best, arg_min(ch, {{'p': -({PRIO.format(c='ch')}), 's': seq}}) AS first, bool_or(ch = '<') AS lt, bool_or(ch = '>') AS gt FROM edges GROUP BY 1, 2)
SELECT src, dst, CASE WHEN best = 5 AND lt AND gt AND first IN ('<', '>') THEN 'x' ELSE first END AS ch FROM a
""")
def suggest_combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.combine_suggestions(lift.edges(spark, sf_dir), ["src", "dst"])


LATTICE = (
    "CASE WHEN bool_or(ch = 'x') OR (bool_or(ch = '<') AND bool_or(ch = '>')) THEN 'x' WHEN bool_or(ch = 'n') AND max(" + PRIO.format(c="ch") + ") = 5 THEN 'n' "
    "WHEN bool_or(ch = '<') THEN '<' WHEN bool_or(ch = '>') THEN '>' ELSE arg_max(ch, {'p': " + PRIO.format(c="ch") + ", 'c': ch}) END"
)


@query(f"""
WITH {CELLS} SELECT a.n_regionkey AS msrc, b.n_regionkey AS mdst, {LATTICE} AS ch FROM cells JOIN nation a ON src = a.n_nationkey JOIN nation b ON dst = b.n_nationkey
WHERE a.n_regionkey <> b.n_regionkey AND ch NOT IN ('p', 'o', '.') AND tracker = '1-URGENT' GROUP BY 1, 2
""")
def module_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = nations(spark, sf_dir).select(F.col("key").alias("path"), "module")
    return merge.module_edges(one(lift.cells(spark, sf_dir), "1-URGENT"), m)


def path_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between nation directories, by path."""
    r, n = lift.table(spark, sf_dir, "region"), lift.table(spark, sf_dir, "nation")
    p = n.join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"]).select("n_nationkey", F.concat(F.lit("/"), "r_name", F.lit("/"), "n_name").alias("path"))
    a, b = p.select(F.col("n_nationkey").alias("a"), F.col("path").alias("pa")), p.select(F.col("n_nationkey").alias("b"), F.col("path").alias("pb"))
    e = lift.edges(spark, sf_dir)
    return e.join(F.broadcast(a), e["src"] == a["a"]).join(F.broadcast(b), e["dst"] == b["b"]).select("tracker", F.col("pa").alias("src"), F.col("pb").alias("dst"), "ch", "seq")


def directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lift.paths(spark, sf_dir).where("is_dir")


DIRS = f"""
{EDGES}, rp AS (SELECT r_regionkey, '/' || r_name AS path FROM region), np AS (SELECT n_nationkey, rp.path || '/' || n_name AS path, rp.path AS parent FROM nation JOIN rp ON n_regionkey = r_regionkey),
pe AS (SELECT tracker, a.path AS src, b.path AS dst, ch, seq FROM edges JOIN np a ON src = a.n_nationkey JOIN np b ON dst = b.n_nationkey),
anc AS (SELECT parent AS ancestor, path AS node FROM np)
"""


@query(f"""
WITH {DIRS}, up AS (SELECT src, dst, ch FROM pe UNION ALL SELECT ancestor, dst, ch FROM pe JOIN anc ON anc.node = pe.src WHERE NOT EXISTS (SELECT 1 FROM anc i WHERE i.ancestor = anc.ancestor AND i.node = pe.dst))
SELECT src, dst, {LATTICE} AS ch FROM up GROUP BY 1, 2 HAVING {LATTICE} <> 'p'
""")
def module_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    up = tree.deep_closure(directories(spark, sf_dir)).select("ancestor", "node")
    return merge.roll_up(path_edges(spark, sf_dir).select("src", "dst", "ch"), up)


@query(f"""
WITH {DIRS}, pairs AS (SELECT a.path AS sdir, b.path AS tdir FROM rp a JOIN rp b ON a.path <> b.path), e AS (SELECT * FROM pe),
best AS (SELECT s.ancestor AS sdir, t.ancestor AS tdir, arg_max(ch, {{'p': {PRIO.format(c='ch')}, 'c': ch}}) AS top, bool_or(ch = '<') AS lt, bool_or(ch = '>') AS gt, count(*) AS n
         FROM e JOIN anc s ON s.node = e.src JOIN anc t ON t.node = e.dst GROUP BY 1, 2)
SELECT sdir, tdir, CASE WHEN top IS NULL THEN 'n' WHEN lt AND gt THEN 'x' WHEN top IN ('p', 's', 'S') THEN 'unresolved' ELSE top END AS verdict, coalesce(n, 0) AS n_edges FROM pairs LEFT JOIN best USING (sdir, tdir)
""")
def dir_pair_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = directories(spark, sf_dir).where("parent_path IS NULL").select("path")  # the project's top-level directories, 26 at most
    pairs = roots.select(F.col("path").alias("sdir")).join(F.broadcast(roots.select(F.col("path").alias("tdir"))), F.expr("sdir <> tdir"))
    up = tree.deep_closure(directories(spark, sf_dir)).select("ancestor", "node")
    return merge.directory_pairs(pairs, path_edges(spark, sf_dir).select("src", "dst", "ch"), up)


BRANK = "CASE WHEN {c} = 'x' THEN 60 WHEN {c} IN ('<', '>') THEN 50 WHEN {c} = 'd' THEN 40 WHEN {c} = 'n' THEN 35 WHEN {c} = 'S' THEN 23 WHEN {c} = 's' THEN 22 WHEN {c} = 'p' THEN 10 ELSE 0 END"
BEST = f"best AS (SELECT src, dst, arg_max(ch, {{'p': {BRANK.format(c='ch')}, 'c': ch}}) AS best FROM cells GROUP BY 1, 2)"


@query(f"WITH {CELLS}, {BEST} SELECT src, dst, best FROM best")
def batch_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.batch_best(lift.cells(spark, sf_dir))


@query(f"WITH {CELLS}, {BEST} SELECT tracker, src, dst, CASE WHEN {BRANK.format(c='best')} > {BRANK.format(c='ch')} THEN best ELSE ch END AS ch, {BRANK.format(c='best')} > {BRANK.format(c='ch')} AS changed FROM cells JOIN best USING (src, dst)")
def batch_consolidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = lift.cells(spark, sf_dir)
    return merge.consolidate(c, merge.batch_best(c))


RECIPROCAL = "CASE {c} WHEN '<' THEN '>' WHEN '>' THEN '<' WHEN 'x' THEN 'x' END"


@query(f"WITH {CELLS} SELECT tracker, src, dst, ch FROM cells UNION SELECT tracker, dst, src, {RECIPROCAL.format(c='ch')} FROM cells WHERE ch IN ('<', '>', 'x')")
def reciprocal_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.with_reciprocals(lift.cells(spark, sf_dir))


@query(f"""
WITH {CELLS}, told AS (SELECT tracker, dst AS src, src AS dst, {RECIPROCAL.format(c='ch')} AS told FROM cells WHERE ch IN ('<', '>', 'x'))
SELECT tracker, src, dst, CASE WHEN told IS NOT NULL AND {PRIO.format(c='told')} >= {PRIO.format(c='ch')} AND ch <> 'n' AND ch <> 'x' THEN told ELSE ch END AS ch FROM cells LEFT JOIN told USING (tracker, src, dst)
""")
def reciprocal_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.apply_reciprocals(lift.cells(spark, sf_dir))


@query(f"""
WITH {CELLS}, base AS (SELECT * FROM cells WHERE (src + dst) % 3 <> 0), sug AS (SELECT tracker, src, dst, ch AS new FROM cells WHERE (src * 7 + dst) % 2 = 0),
opp AS (SELECT tracker, dst AS src, src AS dst, ch AS back FROM base), told AS (SELECT tracker, dst AS src, src AS dst, new AS told FROM sug)
SELECT tracker, src, dst,
  CASE WHEN coalesce((new = '>' AND back = '<') OR (new = '<' AND back = '>'), false) OR coalesce((told = '>' AND ch = '<') OR (told = '<' AND ch = '>'), false) THEN 'x'
       WHEN new IS NOT NULL AND (coalesce(ch, 'p') IN ('p', '.') OR {PRIO.format(c='new')} > {PRIO.format(c="coalesce(ch, 'p')")}) THEN new ELSE coalesce(ch, 'p') END AS ch
FROM base FULL JOIN sug USING (tracker, src, dst) LEFT JOIN opp USING (tracker, src, dst) LEFT JOIN told USING (tracker, src, dst)
""")
def suggestion_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = lift.cells(spark, sf_dir)
    return merge.apply_suggestions(c.where("(src + dst) % 3 <> 0"), c.where("(src * 7 + dst) % 2 = 0"))


@query(f"""
WITH {NODES}, d AS (SELECT path, parent_path FROM nodes WHERE is_dir) SELECT path AS src, parent_path AS dst, 'x' AS ch FROM d WHERE parent_path IS NOT NULL UNION ALL SELECT parent_path, path, 'x' FROM d WHERE parent_path IS NOT NULL
""")
def structural_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ancestors and descendants depend on each other where nothing else is known."""
    up = tree.deep_closure(directories(spark, sf_dir))
    x = F.lit("x").alias("ch")
    return up.select(F.col("node").alias("src"), F.col("ancestor").alias("dst"), x).unionByName(up.select(F.col("ancestor").alias("src"), F.col("node").alias("dst"), x))


@query(f"""
WITH {CELLS}, internal AS (SELECT t.tracker, n_nationkey AS node FROM nation JOIN (SELECT DISTINCT tracker FROM cells) t ON n_regionkey = CAST(substr(t.tracker, 1, 1) AS INT) - 1),
sug AS (SELECT * FROM cells WHERE ch = 's'), live AS (SELECT * FROM cells WHERE ch NOT IN ('p', 'o', '.', 'n', 's') AND (src + dst) % 4 = 0),
touch AS (SELECT 3 AS rank, * FROM live UNION ALL SELECT 4, * FROM sug),
t AS (SELECT tracker, node, 1 AS rank FROM internal UNION ALL SELECT DISTINCT tracker, CAST(24 AS INT), 2 FROM cells
  UNION ALL SELECT tracker, dst, rank FROM touch WHERE (tracker, src) IN (SELECT (tracker, node) FROM internal) UNION ALL SELECT tracker, src, rank FROM touch WHERE (tracker, dst) IN (SELECT (tracker, node) FROM internal))
SELECT tracker, node, ['internal', 'pinned', 'established', 'suggested'][min(rank)] AS why FROM t GROUP BY 1, 2
""")
def tracker_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each tracker keeps, with one region of its own and one pinned nation."""
    c = lift.cells(spark, sf_dir)
    trackers = c.select("tracker").distinct()
    n = nations(spark, sf_dir)
    own = trackers.join(F.broadcast(n), F.col("module") == F.substring("tracker", 1, 1).cast("int") - 1).select("tracker", F.col("key").alias("node"))
    pins = trackers.select("tracker", F.lit(24).alias("node"))
    return merge.members(c.where("ch <> 's' AND (src + dst) % 4 = 0"), own, pins, c.where("ch = 's'"))


@query(f"""
WITH {CELLS}, a AS (SELECT * FROM cells WHERE tracker = '1-URGENT' AND (src + dst) % 2 = 0), b AS (SELECT * FROM cells WHERE tracker = '2-HIGH')
SELECT src, dst, coalesce(nullif(a.ch, 'p'), nullif(b.ch, 'p'), 'p') AS ch FROM a FULL JOIN b USING (src, dst)
""")
def tracker_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = lift.cells(spark, sf_dir)
    return merge.merge_trackers(one(c, "1-URGENT").where("(src + dst) % 2 = 0"), one(c, "2-HIGH"))


@query(f"WITH {CELLS} SELECT tracker, src, dst, ch FROM cells WHERE src NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2) AND dst NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
def tracker_remove_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.remove_path(lift.cells(spark, sf_dir), nations(spark, sf_dir).where("module = 2").select(F.col("key").alias("node")))


@query(f"""
WITH {CELLS}, c AS (SELECT * FROM cells WHERE (src * 5 + dst + length(tracker)) % 11 = 0), known AS (SELECT tracker, src AS node FROM c UNION SELECT tracker, dst FROM c),
req AS (SELECT DISTINCT n_nationkey AS request, n_nationkey AS src, (n_nationkey + 1) % 25 AS dst FROM nation)
SELECT DISTINCT request, s.tracker FROM req JOIN known s ON s.node = req.src WHERE EXISTS (SELECT 1 FROM known t WHERE t.tracker = s.tracker AND t.node = req.dst)
""")
def broadcast_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = lift.cells(spark, sf_dir).where("(src * 5 + dst + length(tracker)) % 11 = 0")
    n = nations(spark, sf_dir)
    return merge.eligible_trackers(c, n.select(F.col("key").alias("request"), F.col("key").alias("src"), ((F.col("key") + 1) % 25).alias("dst")))


@query(f"WITH {CELLS}, v AS (SELECT src, dst, CASE WHEN (src + dst) % 2 = 0 THEN '<' ELSE 'S' END AS ast FROM (SELECT DISTINCT src, dst FROM cells WHERE (src * dst) % 5 = 1)) SELECT tracker, src, dst, CASE WHEN ast IS NOT NULL AND ({PRIO.format(c='ast')} >= {PRIO.format(c='ch')} OR ch = 'n') THEN ast ELSE ch END AS ch FROM cells LEFT JOIN v USING (src, dst)")
def ast_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = lift.cells(spark, sf_dir)
    v = c.where("(src * dst) % 5 = 1").select("src", "dst").distinct().withColumn("ch", F.when((F.col("src") + F.col("dst")) % 2 == 0, "<").otherwise("S"))
    return merge.override(c, v)


@query(f"""
WITH {CELLS}, a AS (SELECT src, dst, ch FROM cells WHERE tracker = '1-URGENT' AND ch IN ('s', 'S', 'd')), b AS (SELECT src, dst, ch FROM cells WHERE tracker = '2-HIGH' AND ch IN ('<', '>'))
SELECT src, dst, coalesce(b.ch, a.ch) AS ch, CASE WHEN a.ch IS NULL THEN 'structural' WHEN b.ch IS NULL THEN 'semantic' ELSE 'both' END AS origin FROM a FULL JOIN b USING (src, dst)
""")
def ast_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = lift.cells(spark, sf_dir)
    return merge.overlay(one(c, "1-URGENT").where("ch IN ('s', 'S', 'd')"), one(c, "2-HIGH").where("ch IN ('<', '>')"))


@query(f"WITH {CELLS} SELECT ch, dst, string_agg(tracker, '|' ORDER BY tracker) AS trackers FROM cells WHERE src = 7 AND ch NOT IN ('o', '.') GROUP BY 1, 2")
def show_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that trackers say about one key, by character; nothing is merged."""
    return lift.cells(spark, sf_dir).where("src = 7 AND ch NOT IN ('o', '.')").groupBy("ch", "dst").agg(F.array_join(F.array_sort(F.collect_set("tracker")), "|").alias("trackers"))


@query(f"WITH {CELLS} SELECT tracker, src AS key, string_agg(DISTINCT ch, '' ORDER BY ch) AS checks FROM cells WHERE ch IN ('p', 's', 'S') GROUP BY 1, 2")
def show_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that still need a check, and for which characters."""
    return lift.cells(spark, sf_dir).where("ch IN ('p', 's', 'S')").groupBy("tracker", F.col("src").alias("key")).agg(F.array_join(F.array_sort(F.collect_set("ch")), "").alias("checks"))


@query(f"WITH {CELLS} SELECT coalesce(tracker, 'total') AS tracker, count(*) FILTER (ch = 'p') AS p, count(*) FILTER (ch = 's') AS s, count(*) FILTER (ch = 'S') AS strong FROM cells GROUP BY ROLLUP (tracker)")
def show_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unverified cells for each tracker and in all."""
    c = F.col("ch")
    return lift.cells(spark, sf_dir).rollup("tracker").agg(F.count_if(c == "p").alias("p"), F.count_if(c == "s").alias("s"), F.count_if(c == "S").alias("strong")).withColumn("tracker", F.coalesce("tracker", F.lit("total")))


@query(f"""WITH {CELLS} SELECT tracker, '  "' || src || '" -> "' || dst || '" [label="' || ch || '"];' AS dot, src || ',' || dst || ',' || ch AS csv FROM cells WHERE ch NOT IN ('.', 'o', 'p')""")
def export_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the csv and dot exports."""
    src, dst = F.col("src").cast("string"), F.col("dst").cast("string")
    return lift.cells(spark, sf_dir).where("ch NOT IN ('.', 'o', 'p')").select("tracker", F.format_string('  "%s" -> "%s" [label="%s"];', src, dst, "ch").alias("dot"), F.concat_ws(",", src, dst, "ch").alias("csv"))


# ---- dense grids ----

GRID = f"""
{CELLS}, k AS (SELECT tracker, n_nationkey AS key FROM (SELECT DISTINCT o_orderpriority AS tracker FROM orders), nation),
full_grid AS (SELECT a.tracker, a.key AS src, b.key AS dst, CASE WHEN a.key = b.key THEN 'o' ELSE coalesce(c.ch, 'p') END AS ch FROM k a JOIN k b ON a.tracker = b.tracker LEFT JOIN cells c ON c.tracker = a.tracker AND c.src = a.key AND c.dst = b.key),
plain AS (SELECT tracker, src AS key, string_agg(ch, '' ORDER BY dst) AS plain FROM full_grid GROUP BY 1, 2),
runs AS (SELECT tracker, src, ch, grp, count(*) AS n, min(dst) AS first_dst FROM (SELECT *, dst - row_number() OVER (PARTITION BY tracker, src, ch ORDER BY dst) AS grp FROM full_grid) GROUP BY ALL),
rle AS (SELECT tracker, src AS key, string_agg(CASE WHEN n >= 3 AND ch <> 'o' THEN ch || CAST(n AS VARCHAR) ELSE repeat(ch, CAST(n AS INT)) END, '' ORDER BY first_dst) AS row FROM runs GROUP BY 1, 2)
"""


def grid_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.pivot(lift.cells(spark, sf_dir), tracker_keys(spark, sf_dir))


@query(f"WITH {GRID} SELECT tracker, key, row FROM rle")
def grid_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid_rows(spark, sf_dir)


@query(f"WITH {GRID} SELECT tracker, key, row AS coded, length(row) AS n FROM rle")
def rle_compress(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = grid_rows(spark, sf_dir).select("tracker", "key", codec.decode(F.col("row")).alias("plain"))
    return plain.select("tracker", "key", codec.encode(F.col("plain")).alias("coded")).withColumn("n", F.length("coded").cast("long"))


@query(f"WITH {GRID} SELECT tracker, key, plain FROM plain")
def rle_decompress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid_rows(spark, sf_dir).select("tracker", "key", codec.decode(F.col("row")).alias("plain"))


@query(f"WITH {GRID} SELECT tracker, key, substr(plain, 8, 1) AS eighth, CAST(NULL AS VARCHAR) AS beyond FROM plain")
def grid_char_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid_rows(spark, sf_dir).select("tracker", "key", codec.char_at(F.col("row"), F.lit(7)).alias("eighth"), codec.char_at(F.col("row"), F.lit(25)).alias("beyond"))


@query(f"WITH {GRID} SELECT tracker, key, substr(plain, 1, 3) || 'd' || substr(plain, 5) AS plain FROM plain")
def grid_set_char(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid_rows(spark, sf_dir).select("tracker", "key", codec.decode(codec.set_char(F.col("row"), F.lit(3), F.lit("d"))).alias("plain"))


@query("""
WITH k AS (SELECT tracker, n_nationkey AS key FROM (SELECT DISTINCT o_orderpriority AS tracker FROM orders), nation)
SELECT tracker, key, CASE WHEN key >= 3 THEN 'p' || CAST(key AS VARCHAR) ELSE repeat('p', key) END || 'o' || CASE WHEN 24 - key >= 3 THEN 'p' || CAST(24 - key AS VARCHAR) ELSE repeat('p', 24 - key) END AS row FROM k
""")
def grid_initial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.initial(tracker_keys(spark, sf_dir))


@query(f"""
WITH {GRID} SELECT tracker, key, CASE WHEN key % 10 = 1 THEN 'key without row' WHEN key % 10 = 2 THEN 'wrong length' ELSE 'wrong diagonal' END AS problem FROM plain WHERE key % 10 IN (1, 2, 3)
UNION ALL SELECT tracker, 99, 'row without key' FROM (SELECT DISTINCT tracker FROM plain)
""")
def grid_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that were damaged on purpose."""
    r = grid_rows(spark, sf_dir)
    plain, m = codec.decode(F.col("row")), F.col("key") % 10
    bad = r.where(m != 1).select("tracker", "key", F.when(m == 2, F.concat("row", F.lit("p"))).when(m == 3, F.overlay(plain, F.lit("s"), F.col("key") + 1, F.lit(1))).otherwise(F.col("row")).alias("row"))
    extra = r.where("key = 0").select("tracker", F.lit(99).alias("key"), "row")
    return grid.violations(bad.unionByName(extra), tracker_keys(spark, sf_dir))


@query(f"WITH {GRID} SELECT tracker, src, dst, ch FROM full_grid WHERE src <> dst AND ch NOT IN ('o', '.')")
def grid_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.unpivot(grid_rows(spark, sf_dir), tracker_keys(spark, sf_dir))


@query(f"WITH {CELLS} SELECT tracker, src, ch, string_agg(CAST(dst AS VARCHAR), ',' ORDER BY dst) AS targets FROM cells WHERE ch NOT IN ('n', '.', 'o') GROUP BY 1, 2, 3")
def grid_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.by_character(lift.cells(spark, sf_dir)).withColumn("targets", F.array_join("targets", ","))


@query(f"""
WITH {CELLS}, ch AS (SELECT DISTINCT tracker, src, CASE WHEN dst % 6 = 5 THEN 77 ELSE CAST((src + dst) % 25 AS INT) END AS dst FROM cells WHERE dst % 3 = 2),
ok AS (SELECT tracker, src, dst, CASE WHEN dst % 2 = 0 THEN '.' ELSE '>' END AS new FROM ch WHERE src <> dst AND dst <> 77)
SELECT tracker, src, dst, coalesce(new, cells.ch) AS ch FROM cells FULL JOIN ok USING (tracker, src, dst)
""")
def grid_add_remove_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits: some set an edge, some clear one, some name an unknown key or the diagonal."""
    c = lift.cells(spark, sf_dir)
    dst = F.when(F.col("dst") % 6 == 5, 77).otherwise((F.col("src") + F.col("dst")) % 25)
    changes = c.where("dst % 3 = 2").select("tracker", "src", dst.alias("dst")).distinct().withColumn("ch", F.when(F.col("dst") % 2 == 0, ".").otherwise(">"))
    return grid.upsert(c, changes, tracker_keys(spark, sf_dir))
