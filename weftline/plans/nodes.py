"""Queries on nodes, keys and paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import chars, keys, text
from weftline.operators import layout, tree
from weftline.plans import lift
from weftline.plans.lift import NODES
from weftline.plans.registry import query


@query(f"WITH {NODES} SELECT key, path, parent_path, CAST(tier AS INT) AS tier, is_dir FROM nodes")
def node_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lift.nodes(spark, sf_dir)


@query("""
WITH p AS (SELECT DISTINCT p_brand AS b, split_part(p_type, ' ', 1) AS t, CAST(p_size // 10 AS VARCHAR) AS s FROM part),
b AS (SELECT b, '/' || b AS path, '1' || chr(CAST(64 + row_number() OVER (ORDER BY b) AS INT)) AS key FROM (SELECT DISTINCT b FROM p)),
t AS (SELECT x.b, x.t, b.path || '/' || x.t AS path, b.key || chr(CAST(96 + row_number() OVER (PARTITION BY x.b ORDER BY x.t) AS INT)) AS key FROM (SELECT DISTINCT b, t FROM p) x JOIN b USING (b)),
s AS (SELECT x.b, x.t, x.s, t.path || '/' || x.s AS path, '2' || chr(CAST(64 + row_number() OVER (PARTITION BY x.b, x.t ORDER BY x.s) AS INT)) AS key FROM p x JOIN t USING (b, t)),
f AS (SELECT s.path || '/' || p_partkey AS path, s.key || CAST(row_number() OVER (PARTITION BY s.path ORDER BY s.path || '/' || p_partkey) AS VARCHAR) AS key
      FROM part JOIN s ON s.b = p_brand AND s.t = split_part(p_type, ' ', 1) AND s.s = CAST(p_size // 10 AS VARCHAR))
SELECT key, path, CAST(1 AS INT) AS tier FROM b UNION ALL SELECT key, path, 1 FROM t UNION ALL SELECT key, path, 2 FROM s UNION ALL SELECT key, path, 2 FROM f
""")
def node_keys_promoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of four levels: directories below lettered directories move to tier 2."""
    p = lift.table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("/"), "p_brand").alias("l1"), F.split("p_type", " ")[0].alias("t"), F.floor(F.col("p_size") / 10).cast("string").alias("s"))
    p = p.withColumn("l2", F.concat_ws("/", "l1", "t")).withColumn("l3", F.concat_ws("/", "l2", "s"))
    folder = lambda path, parent: p.select(F.col(path).alias("path"), (F.col(parent) if parent else F.lit(None).cast("string")).alias("parent_path"), F.lit(True).alias("is_dir")).distinct()
    leaf = p.select(F.concat_ws("/", "l3", F.col("p_partkey").cast("string")).alias("path"), F.col("l3").alias("parent_path"), F.lit(False).alias("is_dir"))
    return tree.assign_keys(folder("l1", None).unionByName(folder("l2", "l1")).unionByName(folder("l3", "l2")).unionByName(leaf), levels=4).select("key", "path", "tier")


@query(f"""
WITH {NODES}, k AS (SELECT key, path, list_transform(regexp_extract_all(key, '\\d+|\\D+'), lambda p: CASE WHEN regexp_matches(p, '^\\d') THEN lpad(p, 12, '0') ELSE p END) AS parts, parent_path FROM nodes)
SELECT key, path, array_to_string(parts, '') AS natural_key, row_number() OVER (PARTITION BY parent_path ORDER BY array_to_string(parts, ''), path) AS ord FROM k WHERE key <> ''
""")
def key_natural_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order among siblings, numbers as numbers."""
    n = lift.nodes(spark, sf_dir).where("key IS NOT NULL AND key <> ''").withColumn("natural_key", keys.natural(F.col("key")))
    return n.select("key", "path", "natural_key", F.row_number().over(Window.partitionBy("parent_path").orderBy("natural_key", "path")).cast("long").alias("ord"))


VARIANTS = f"""
WITH {NODES}, v AS (SELECT key || CASE length(path) % 4 WHEN 0 THEN '' WHEN 1 THEN '#2' WHEN 2 THEN '#x' ELSE '#0' END AS raw FROM nodes)
SELECT raw, split_part(raw, '#', 1) AS base, TRY_CAST(CASE WHEN contains(raw, '#') THEN split_part(raw, '#', 2) END AS INT) AS instance,
       regexp_matches(raw, '^[1-9]\\d*[A-Z](?:[a-z](?:[1-9]\\d*)?|[1-9]\\d*)?(?:#[1-9]\\d*)?$') AS valid, count(*) AS n
FROM v GROUP BY ALL
"""


@query(VARIANTS)
def key_split_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.length("path") % 4
    raw = F.concat("key", F.when(size == 0, "").when(size == 1, "#2").when(size == 2, "#x").otherwise("#0"))
    v = lift.nodes(spark, sf_dir).select(raw.alias("raw"))
    inst = F.expr("try_cast(try_element_at(split(raw, '#'), 2) AS int)")
    return v.select("raw", keys.base(F.col("raw")).alias("base"), inst.alias("instance"), keys.valid(F.col("raw")).alias("valid")).groupBy("raw", "base", "instance", "valid").agg(F.count(F.lit(1)).alias("n"))


#: Keys made ambiguous on purpose: customers' and suppliers' numbers modulo 500 within their nation's letter.
SHARED_KEYS = f"""
{NODES}, dup AS (SELECT '1' || chr(CAST(65 + length(path) % 5 AS INT)) || CAST(1 + CAST(regexp_extract(path, '(\\d+)$', 1) AS BIGINT) % 500 AS VARCHAR) AS base, path, parent_path FROM nodes WHERE NOT is_dir),
g AS (SELECT base, path, parent_path, count(*) OVER (PARTITION BY base) AS n, row_number() OVER (PARTITION BY base ORDER BY path) AS nth FROM dup),
gk AS (SELECT base, path, parent_path, n, CASE WHEN n > 1 THEN base || '#' || CAST(nth AS VARCHAR) ELSE base END AS gkey FROM g)
"""


def shared_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = lift.nodes(spark, sf_dir).where("NOT is_dir")
    key = F.concat(F.lit("1"), F.char(F.lit(65) + F.length("path") % 5), (1 + F.regexp_extract("path", r"(\d+)$", 1).cast("long") % 500).cast("string"))
    return tree.instance_suffixes(files.select(key.alias("key"), "path", "parent_path"))


@query(f"WITH {SHARED_KEYS} SELECT gkey, base, path FROM gk")
def key_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_keys(spark, sf_dir).select("gkey", "base", "path")


@query(f"""
WITH {SHARED_KEYS}, req AS (SELECT DISTINCT base AS want, min(parent_path) OVER (PARTITION BY base) AS context FROM gk UNION SELECT gkey, NULL FROM gk UNION SELECT '9Z9', NULL),
near AS (SELECT base, parent_path, count(*) AS n, min(path) AS path FROM gk GROUP BY 1, 2), b AS (SELECT base, count(*) AS n, min(path) AS path FROM gk GROUP BY 1)
SELECT r.want, r.context,
       CASE WHEN e.path IS NOT NULL THEN e.path WHEN b.n = 1 THEN b.path WHEN near.n = 1 THEN near.path END AS path,
       CASE WHEN e.path IS NOT NULL THEN 'exact' WHEN b.n IS NULL THEN 'missing' WHEN b.n = 1 THEN 'base' WHEN near.n = 1 THEN 'context' ELSE 'ambiguous' END AS status
FROM req r LEFT JOIN gk e ON e.gkey = r.want LEFT JOIN b ON b.base = r.want LEFT JOIN near ON near.base = r.want AND near.parent_path = r.context
""")
def key_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every base key (with the first parent as context), every full key, and one that does not exist."""
    n = shared_keys(spark, sf_dir)
    bases = n.groupBy("base").agg(F.min("parent_path").alias("context")).select(F.col("base").alias("want"), "context")
    none = F.lit(None).cast("string").alias("context")
    requests = bases.unionByName(n.select(F.col("gkey").alias("want"), none)).unionByName(spark.range(1).select(F.lit("9Z9").alias("want"), none)).distinct()
    return tree.resolve(requests, n)


@query(f"WITH {SHARED_KEYS} SELECT base, count(*) AS n FROM gk GROUP BY base HAVING count(*) > 1")
def key_ambiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_keys(spark, sf_dir).groupBy("base").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("""
WITH o AS (SELECT c_name AS path, 'k' || CAST(c_custkey % 100 AS VARCHAR) AS old_key FROM customer WHERE c_custkey % 5 <> 0),
n AS (SELECT c_name AS path, 'k' || CAST(CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 97 ELSE c_custkey % 100 END AS VARCHAR) AS new_key FROM customer WHERE c_custkey % 7 <> 0)
SELECT coalesce(o.path, n.path) AS path, old_key, new_key,
       CASE WHEN new_key IS NULL THEN 'removed' WHEN old_key IS NULL THEN 'added' WHEN old_key = new_key THEN 'stable' ELSE 'moved' END AS change
FROM o FULL JOIN n ON o.path = n.path
""")
def path_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of a key map against each other, by path."""
    c = lift.table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("path"))
    key = lambda x: F.concat(F.lit("k"), x.cast("string"))
    k = F.col("c_custkey")
    old = c.where("c_custkey % 5 <> 0").select("path", key(k % 100).alias("key"))
    new = c.where("c_custkey % 7 <> 0").select("path", key(F.when(k % 3 == 0, k % 97).otherwise(k % 100)).alias("key"))
    return tree.migration(old, new)


@query("""
WITH o AS (SELECT c_name AS path, c_custkey % 100 AS key FROM customer WHERE c_custkey % 5 <> 0), n AS (SELECT c_name AS path, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 97 ELSE c_custkey % 100 END AS key FROM customer WHERE c_custkey % 7 <> 0)
(SELECT 'old' AS side, path, key FROM (SELECT * FROM o EXCEPT SELECT * FROM n)) UNION ALL (SELECT 'new', path, key FROM (SELECT * FROM n EXCEPT SELECT * FROM o))
""")
def key_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symmetric difference of two versions."""
    c = lift.table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    old = c.where("c_custkey % 5 <> 0").select(F.col("c_name").alias("path"), (k % 100).alias("key"))
    new = c.where("c_custkey % 7 <> 0").select(F.col("c_name").alias("path"), F.when(k % 3 == 0, k % 97).otherwise(k % 100).alias("key"))
    side = lambda name, d: d.select(F.lit(name).alias("side"), "path", "key")
    return side("old", old.exceptAll(new)).unionByName(side("new", new.exceptAll(old)))


@query(f"""
WITH RECURSIVE {NODES}, up AS (SELECT parent_path AS ancestor, path AS node, 1 AS distance FROM nodes WHERE parent_path IS NOT NULL
  UNION ALL SELECT n.parent_path, up.node, up.distance + 1 FROM up JOIN nodes n ON n.path = up.ancestor WHERE n.parent_path IS NOT NULL)
SELECT ancestor, count(*) AS descendants, count(*) FILTER (distance = 1) AS children, max(distance) AS depth FROM up GROUP BY ancestor
""")
def tree_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    up = tree.deep_closure(lift.paths(spark, sf_dir))
    return up.groupBy("ancestor").agg(F.count(F.lit(1)).alias("descendants"), F.count_if(F.col("distance") == 1).alias("children"), F.max("distance").alias("depth"))


@query("""
WITH RECURSIVE e AS (SELECT event_id AS node, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS parent FROM events),
up AS (SELECT node, parent AS ancestor, 1 AS distance FROM e WHERE parent IS NOT NULL UNION ALL SELECT up.node, e.parent, up.distance + 1 FROM up JOIN e ON e.node = up.ancestor WHERE e.parent IS NOT NULL),
above AS (SELECT node, count(*) AS ancestors, arg_max(ancestor, distance) AS root FROM up GROUP BY node), below AS (SELECT ancestor AS node, count(*) AS descendants FROM up GROUP BY ancestor)
SELECT CAST(e.node AS VARCHAR) AS path, coalesce(ancestors, 0) AS ancestors, coalesce(descendants, 0) AS descendants, CAST(coalesce(root, e.node) AS VARCHAR) AS root FROM e LEFT JOIN above USING (node) LEFT JOIN below USING (node)
""")
def chain_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as a chain, whose depth grows with the table: how many lie above and below each."""
    e = lift.table(spark, sf_dir, "events")
    before = F.lag("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    nodes = e.select(F.col("event_id").cast("string").alias("path"), before.cast("string").alias("parent_path"))
    return tree.extents(nodes).select("path", "ancestors", "descendants", "root")


@query(f"WITH {NODES} SELECT path, parent_path AS module FROM nodes WHERE NOT is_dir")
def file_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lift.paths(spark, sf_dir).where("NOT is_dir").select("path", F.col("parent_path").alias("module"))


EXTENSIONS = "['py', 'js', 'md', 'rst', 'txt', 'html', 'sql', 'tsx', 'java', 'css']"


@query(f"""
WITH f AS (SELECT 'src' || CAST(doc_id % 20 AS VARCHAR) || '/f' || CAST(doc_id AS VARCHAR) || '.' || {EXTENSIONS}[CAST(1 + doc_id % 10 AS INT)] AS path FROM documents),
t AS (SELECT path, lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) AS e FROM f)
SELECT CASE WHEN e IN ('js', 'tsx') THEN 'js' WHEN e IN ('md', 'rst') THEN 'md' WHEN e = 'java' THEN 'generic' ELSE e END AS file_type, CASE WHEN e IN ('md', 'rst', 'txt') THEN 'doc' ELSE 'code' END AS role,
       CASE WHEN path LIKE 'src1/%' THEN 'doc' WHEN path LIKE 'src%' THEN 'code' END AS item_type, count(*) AS n
FROM t GROUP BY ALL
""")
def file_type_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type by extension, role by extension, kind by root (documentation roots win)."""
    ext = F.element_at(F.array(*map(F.lit, ("py", "js", "md", "rst", "txt", "html", "sql", "tsx", "java", "css"))), (1 + F.col("doc_id") % 10).cast("int"))
    f = lift.table(spark, sf_dir, "documents").select(F.concat(F.lit("src"), (F.col("doc_id") % 20).cast("string"), F.lit("/f"), F.col("doc_id").cast("string"), F.lit("."), ext).alias("path"))
    p = F.col("path")
    kind = F.when(text.under(p, F.lit("src1")), "doc").when(p.startswith("src"), "code")
    return f.select(chars.file_type(p).alias("file_type"), chars.role(p).alias("role"), kind.alias("item_type")).groupBy("file_type", "role", "item_type").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
WITH {NODES}, x AS (SELECT path, is_dir,
  regexp_matches(path, '^/ASIA(/|$)') OR regexp_matches(path, '/[^/]*0000001[^/]*$') AS excluded, starts_with(path, '/EUROPE/') AS below_europe, is_dir AND (path = '/AMERICA' OR starts_with(path, '/AMERICA/')) AS main_key, path = '/AFRICA' OR starts_with(path, '/AFRICA/') AS doc_key FROM nodes)
SELECT excluded, below_europe, main_key, doc_key, count(*) AS n, min(path) AS first_path FROM x GROUP BY ALL
""")
def path_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exclusion by path or pattern of any ancestor, subpath, main and documentation membership."""
    p = F.col("path")
    excluded = p.rlike(r"^/ASIA(/|$)") | p.rlike(r"/[^/]*0000001[^/]*$")
    inside = lambda root: (p == root) | text.under(p, F.lit(root))
    x = lift.paths(spark, sf_dir).select("path", excluded.alias("excluded"), text.under(p, F.lit("/EUROPE")).alias("below_europe"), (F.col("is_dir") & inside("/AMERICA")).alias("main_key"), inside("/AFRICA").alias("doc_key"))
    return x.groupBy("excluded", "below_europe", "main_key", "doc_key").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first_path"))


@query("""
SELECT url, regexp_replace(regexp_extract(url, '^https?://[^/]+([^?#]*)', 1), '/$', '') AS path, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host,
       CASE WHEN starts_with(url, 'https://') THEN substr(url, 9) ELSE substr(url, 8) END AS tail
FROM pages
""")
def path_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of urls, folded; what follows the scheme, relative to it."""
    raw = F.regexp_extract("url", r"^https?://[^/]+([^?#]*)", 1)
    messy = F.regexp_replace(raw, "/", "//./")
    scheme = F.when(F.col("url").startswith("https://"), "https:/").otherwise("http:/")
    return lift.table(spark, sf_dir, "pages").select("url", F.when(raw.isin("", "/"), "").otherwise(text.normal_path(messy)).alias("path"), F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("host"), text.relative(F.col("url"), scheme).alias("tail"))


EXTENSIONS, PREFIXES = [".py", ".js", ".sql", ".md"], ["#", "//", "--", "<!--"]


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, path, content: documents as files of four kinds, between a tool's header, a tagged comment, and marks in code and strings."""
    d = lift.table(spark, sf_dir, "documents")
    kind = (F.col("doc_id") % 4).cast("int")
    p = F.array(*map(F.lit, PREFIXES))[kind]
    html = p == "<!--"
    head = F.when(html, F.lit("<!-- --- STATION_HEADER_START --- [AUTO]\nROLE: x\n--- STATION_HEADER_END --- [AUTO] -->\r\n")).otherwise(F.concat(p, F.lit(" --- STATION_HEADER_START --- [AUTO]\n"), p, F.lit(" ROLE: x\n"), p, F.lit(" --- STATION_HEADER_END --- [AUTO]\r\n")))
    content = F.concat(head, F.lit("   x = 1"), p, F.lit("note"), F.when(html, "-->").otherwise(""), F.lit("\r\n"), "text", F.lit('\n\ts = "a '), p, F.lit(' b"\n  '), p, F.lit(" map [AUTO]\n"))
    return d.select("doc_id", F.concat(F.lit("src.d/f"), F.col("doc_id").cast("string"), F.array(*map(F.lit, EXTENSIONS))[kind]).alias("path"), content.alias("content"))


def normal_lines(text_: str, p: str) -> str:
    """DuckDB: the list of normalised lines of a text under a comment mark."""
    bare = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
    code, said = f"x[:strpos(x, {p}) - 1]", f"x[strpos(x, {p}) + length({p}):]"
    closed = f"({p} = '<!--' AND regexp_matches({said}, '-->\\s*$'))"
    even = lambda q: f"(length({code}) - length(replace({code}, '{q}', ''))) % 2 = 0"
    inner = bare(f"CASE WHEN {closed} THEN regexp_replace({said}, '-->\\s*$', '') ELSE {said} END")
    mended = f"CASE WHEN {bare(code)} = '' THEN {p} ELSE {bare(code)} || ' ' || {p} END || ' ' || {inner} || CASE WHEN {closed} THEN ' -->' ELSE '' END"
    touched = f"strpos(x, {p}) > 0 AND ({p} = '<!--' OR {even(chr(39) * 2)} AND {even(chr(34))})"
    lines = f"list_filter(list_transform(regexp_split_to_array({text_}, '\\r\\n|[\\n\\r\\x0b\\f\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda x: {bare('x')}), lambda x: x <> '')"
    return f"list_filter(list_transform({lines}, lambda x: {bare(f'CASE WHEN {touched} THEN {mended} ELSE x END')}), lambda x: x <> '')"


@query(f"""
WITH d AS (SELECT doc_id, text, ({PREFIXES})[1 + doc_id % 4] AS p FROM documents),
l AS (SELECT doc_id, text, p, {normal_lines('text', 'p')} AS lines FROM d)
SELECT doc_id, sha256(array_to_string(list_concat(['x = 1 ' || p || ' note' || CASE WHEN p = '<!--' THEN ' -->' ELSE '' END], lines, ['s = "a ' || p || ' b"']), chr(10))) AS hash, CAST(floor(length(text) / 4) AS BIGINT) AS tokens FROM l
""")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of files by their kind's comment mark, without what tools wrote."""
    files = source_files(spark, sf_dir).join(lift.table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return files.select("doc_id", text.content_hash(F.col("content"), F.col("path")).alias("hash"), text.tokens(F.col("text")).alias("tokens"))


@query(f"""
WITH d AS (SELECT doc_id, '   x = 1' || p || 'note' || CASE WHEN p = '<!--' THEN '-->' ELSE '' END || chr(13) || chr(10) || text || chr(10) || chr(9) || 's = "a ' || p || ' b"' || chr(10) AS rest FROM (SELECT doc_id, text, ({PREFIXES})[1 + doc_id % 4] AS p FROM documents))
SELECT doc_id, sha256(repeat(chr(10), 3) || rest || chr(10)) AS with_lines, sha256(rest) AS without_lines FROM d
""")
def auto_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files without a tool's blocks, once with their line numbers kept."""
    told = lambda keep: F.sha2(text.without_auto(F.col("marked"), F.col("content"), keep), 256)
    return source_files(spark, sf_dir).withColumn("marked", text.auto_lines(F.col("content"), F.col("path"))).select("doc_id", told(True).alias("with_lines"), told(False).alias("without_lines"))


@query(f"""
WITH l AS (SELECT doc_id, {normal_lines('text', "'#'")} AS lines FROM documents)
SELECT sha256(array_to_string(lines, chr(10))) AS hash, count(*) AS n, min(doc_id) AS first_doc FROM l GROUP BY 1 HAVING count(*) > 1
""")
def hash_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = lift.table(spark, sf_dir, "documents").select("doc_id", text.content_hash(F.col("text")).alias("hash"))
    return h.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


@query("SELECT part.p_partkey, (p_size * 977) AS seconds, CASE WHEN p_size * 977 < 60 THEN CAST(p_size * 977 AS VARCHAR) || 's' WHEN p_size * 977 < 3600 THEN CAST(p_size * 977 // 60 AS VARCHAR) || 'm ' || CAST(p_size * 977 % 60 AS VARCHAR) || 's' ELSE CAST(p_size * 977 // 3600 AS VARCHAR) || 'h ' || CAST(p_size * 977 % 3600 // 60 AS VARCHAR) || 'm' END AS took FROM part")
def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("p_size") * 977
    return lift.table(spark, sf_dir, "part").select("p_partkey", s.alias("seconds"), text.duration(s).alias("took"))


def _up(level: str, of: str, name: str) -> str:
    """DuckDB: sizes of the parents of one level's boxes (``of``: path, parent, col, w, h)."""
    return f"""{level}c AS (SELECT parent, col, max(w) AS w, sum(h) + (count(*) - 1) * 28.0 AS h FROM {of} GROUP BY ALL),
{name} AS (SELECT parent AS path, sum(w) + 40.0 + (count(*) - 1) * 100.0 AS w, max(h + (col % 2) * 34.0) + 60.0 AS h FROM {level}c GROUP BY parent)"""


def _off(of: str, name: str) -> str:
    """DuckDB: places inside their parents."""
    return f"""{name}w AS (SELECT parent, col, max(w) AS cw FROM {of} GROUP BY ALL),
{name}l AS (SELECT *, coalesce(sum(cw + 100.0) OVER (PARTITION BY parent ORDER BY col ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l FROM {name}w),
{name} AS (SELECT b.*, CASE WHEN parent IS NULL THEN 32.0 + l + (max(w) OVER (q ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - w) / 2 ELSE 20.0 + l + (cw - w) / 2 END AS dx,
  CASE WHEN parent IS NULL THEN 32.0 ELSE 44.0 END + (col % 2) * 34.0 + coalesce(sum(h + CASE WHEN parent IS NULL THEN 80.0 ELSE 28.0 END) OVER (q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS dy
  FROM (SELECT b.*, l, cw FROM {of} b JOIN {name}l ON b.parent IS NOT DISTINCT FROM {name}l.parent AND b.col = {name}l.col) b WINDOW q AS (PARTITION BY parent, col ORDER BY pos))"""


@query(f"""
WITH {NODES}, s AS (SELECT path, parent_path AS parent, is_dir, key, regexp_extract(key, '^[0-9]+([A-Z])', 1) AS letter, regexp_extract(path, '[^/]+$') AS label FROM nodes),
i AS (SELECT *, row_number() OVER (PARTITION BY parent, letter ORDER BY key, path) - 1 AS i, count(*) OVER (PARTITION BY parent, letter) AS n FROM s),
sub AS (SELECT *, CASE WHEN n > 9 THEN CAST(floor(i / ceil(n / ceil(n / 9))) AS INT) ELSE 0 END AS sub FROM i),
c AS (SELECT path, parent, is_dir, greatest(120.0, length(label) * 7.0 + 24.0) AS w0, row_number() OVER (PARTITION BY parent, letter, sub ORDER BY key, path) - 1 AS pos, dense_rank() OVER (PARTITION BY parent ORDER BY letter, sub) - 1 AS col FROM sub),
files AS (SELECT path, parent, is_dir, pos, col, w0 AS w, 40.0 AS h FROM c WHERE NOT is_dir), {_up('f', 'files', 'fs')},
dirs AS (SELECT c.path, parent, is_dir, pos, col, coalesce(fs.w, w0) AS w, coalesce(fs.h, 68.0) AS h FROM c LEFT JOIN fs USING (path) WHERE is_dir AND parent IS NOT NULL), {_up('d', 'dirs', 'ds')},
roots AS (SELECT c.path, parent, is_dir, pos, col, coalesce(ds.w, w0) AS w, coalesce(ds.h, 68.0) AS h FROM c LEFT JOIN ds USING (path) WHERE parent IS NULL),
{_off('files', 'fo')}, {_off('dirs', 'dof')}, {_off('roots', 'ro')},
a AS (SELECT path, parent, is_dir, dx AS x, dy AS y, w, h FROM ro), b AS (SELECT dof.path, dof.parent, dof.is_dir, a.x + dx AS x, a.y + dy AS y, dof.w, dof.h FROM dof JOIN a ON a.path = dof.parent),
e AS (SELECT fo.path, fo.parent, fo.is_dir, b.x + dx AS x, b.y + dy AS y, fo.w, fo.h FROM fo JOIN b ON b.path = fo.parent)
SELECT path, parent, is_dir, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(w AS DOUBLE) AS width, CAST(h AS DOUBLE) AS height FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM e)
""")
def diagram_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of the whole tree, files in columns of nine."""
    n = lift.nodes(spark, sf_dir)
    return layout.layout(n.select("path", F.col("parent_path").alias("parent"), "is_dir", "key", F.regexp_extract("path", "([^/]+)$", 1).alias("label")))
