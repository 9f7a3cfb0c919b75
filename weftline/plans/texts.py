"""Queries on documents, pages, conversations and lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import text
from weftline.operators import batches, extract
from weftline.plans import lift
from weftline.plans.registry import query


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.lines(lift.table(spark, sf_dir, "documents"))


LINES = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS INT) AS line FROM documents)"


@query("""
WITH r AS (SELECT page_id, 'link' AS kind, unnest(regexp_extract_all(html, '<a\\s+(?:[^>]*?\\s+)?href="([^"]+?)"', 1)) AS url FROM pages
 UNION ALL SELECT page_id, 'stylesheet', unnest(regexp_extract_all(html, '<link\\s+(?:[^>]*?\\s+)?href="([^"]+?)"', 1)) FROM pages
 UNION ALL SELECT page_id, 'script', unnest(regexp_extract_all(html, '<script\\s+(?:[^>]*?\\s+)?src="([^"]+?)"', 1)) FROM pages
 UNION ALL SELECT page_id, 'image', unnest(regexp_extract_all(html, '<img\\s+(?:[^>]*?\\s+)?src="([^"]+?)"', 1)) FROM pages)
SELECT DISTINCT page_id, kind, url FROM r WHERE NOT regexp_matches(url, '^(https?:|mailto:|tel:|#|data:|javascript:)')
""")
def html_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.html_references(lift.table(spark, sf_dir, "pages"))


@query("""
WITH links AS (SELECT DISTINCT page_id, lower(regexp_replace(unnest(regexp_extract_all(html, '<a\\s+(?:[^>]*?\\s+)?href="([^"]+?)"', 1)), '^/|[.,]$', '', 'g')) AS target FROM pages),
hosts AS (SELECT DISTINCT regexp_extract(url, '^https?://(?:www\\.|m\\.|blog\\.)?([^./]+)', 1) AS host FROM pages)
SELECT target, 'd' AS ch, count(DISTINCT page_id) AS n FROM links JOIN hosts ON host = target GROUP BY 1
""")
def html_link_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links resolved against the sites that exist."""
    pages = lift.table(spark, sf_dir, "pages")
    links = extract.html_references(pages).where("kind = 'link'").select("page_id", F.lower(F.regexp_replace("url", "^/|[.,]$", "")).alias("target"))
    hosts = pages.select(F.regexp_extract("url", r"^https?://(?:www\.|m\.|blog\.)?([^./]+)", 1).alias("host")).distinct()
    return links.join(hosts, links["target"] == hosts["host"]).groupBy("target").agg(F.countDistinct("page_id").alias("n")).select("target", F.lit("d").alias("ch"), "n")


@query("""
WITH s AS (SELECT page_id, '@import url("site' || CAST(page_id % 7 AS VARCHAR) || '.css"); @import "https://cdn/x.css"; ' || regexp_extract(html, '<style>([^<]*)</style>', 1) AS css FROM pages)
SELECT page_id, 'site' || CAST(page_id % 7 AS VARCHAR) || '.css' AS path, '<' AS ch FROM s WHERE css LIKE '%p{margin:0}%'
""")
def css_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    css = F.concat(F.lit('@import url("site'), (F.col("page_id") % 7).cast("string"), F.lit('.css"); @import "https://cdn/x.css"; '), F.regexp_extract("html", "<style>([^<]*)</style>", 1))
    sheets = lift.table(spark, sf_dir, "pages").select("page_id", css.alias("css")).where(F.col("css").contains("p{margin:0}"))
    return extract.css_imports(sheets, "page_id", "css").withColumn("ch", F.lit("<"))


@query("""
WITH t AS (SELECT doc_id, regexp_replace(text, '(^|\\n)([A-Z])', '\\1## \\2') || chr(10) || '[in](doc' || CAST(doc_id AS VARCHAR) || '.md) [out](https://x.org/a)' AS text FROM documents)
SELECT doc_id, 'header' AS kind, substr(h, 4) AS value, CAST(2 AS INT) AS level FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?:^|\\n)(## [^\\n]+)', 1)) AS h FROM t)
UNION ALL SELECT doc_id, 'link', 'doc' || CAST(doc_id AS VARCHAR) || '.md', 0 FROM t
""")
def md_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first capitalised line marked as a header, and a local and a foreign link."""
    t = lift.table(spark, sf_dir, "documents")
    first = F.regexp_instr("text", F.lit(r"(?m)^[A-Z]"))
    marked = F.when(first > 0, F.concat(F.expr("substr(text, 1, regexp_instr(text, '(?m)^[A-Z]') - 1)"), F.lit("## "), F.expr("substr(text, regexp_instr(text, '(?m)^[A-Z]'))"))).otherwise(F.col("text"))
    link = F.concat(F.lit("\n[in](doc"), F.col("doc_id").cast("string"), F.lit(".md) [out](https://x.org/a)"))
    return extract.markdown(t.select("doc_id", F.concat(marked, link).alias("text")))


@query(f"""
WITH {LINES}, h AS (SELECT *, regexp_matches(content, '^(The|Le|Der|El|La|Des|In) ') AS h FROM l), n AS (SELECT *, coalesce(lag(h, 1) OVER w, false) OR coalesce(lag(h, 2) OVER w, false) OR coalesce(lag(h, 3) OVER w, false) AS near FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY line))
SELECT doc_id, line, content, CASE WHEN h THEN 'header' ELSE 'context' END AS role FROM n WHERE h OR near
""")
def doc_essence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that open with an article stand for headers, with three lines after each."""
    return extract.essence(doc_lines(spark, sf_dir), F.col("content").rlike("^(The|Le|Der|El|La|Des|In) "))


@query("SELECT conv_id, count(*) AS turns, count(*) FILTER (role = 'user') AS user_turns, CAST(sum(length(text)) AS BIGINT) AS chars, count(*) >= 6 AS is_transcript, arg_min(role, turn) AS opener FROM conversations GROUP BY conv_id")
def transcript_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = lift.table(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.count_if(F.col("role") == "user").alias("user_turns"), F.sum(F.length("text")).cast("long").alias("chars"), (F.count(F.lit(1)) >= 6).alias("is_transcript"), F.min_by("role", "turn").alias("opener"))


@query("SELECT event_id, 'k' AS key, json_extract_string(props, '$.k') AS value FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def json_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.json_keys(lift.table(spark, sf_dir, "events"), "event_id", "props")


MARKS = ["#", "//", "--", "<!--"]
SOURCE = """
k AS (SELECT doc_id, line, p, ext, CASE line % 8 WHEN 1 THEN '  ' || p || ' TODO ' || content WHEN 2 THEN 'x = 1 ' || p || ' FIXME ' || content WHEN 3 THEN p || ' wip placeholder' WHEN 4 THEN '  pass' WHEN 5 THEN 'raise NotImplementedError(1)' WHEN 6 THEN p || ' a placeholder_x, Simplified for now'
  WHEN 7 THEN 'def f(): pass' ELSE content END AS content FROM (SELECT *, (['#', '//', '--', '<!--'])[1 + doc_id % 4] AS p, (['.py', '.js', '.sql', '.md'])[1 + doc_id % 4] AS ext FROM l)),
m AS (SELECT *, starts_with(regexp_replace(content, '^\\s+', ''), p) AS c, regexp_matches(content, '(?i)WIP') AS wip FROM k)
"""
EXCLUDED = r'(?i)_placeholder|placeholder_|sql\.Placeholder|placeholders\s*=|placeholder\s*=|placeholder\s*:|Placeholder\(\)|\.placeholder\.|"placeholder"'


@query(f"""
WITH {LINES}, {SOURCE}, t AS (SELECT doc_id, line, unnest(list_filter([
  CASE WHEN c AND NOT wip AND regexp_matches(content, '(?i)TODO') THEN 'TODO' END, CASE WHEN c AND NOT wip AND regexp_matches(content, '(?i)FIXME') THEN 'FIXME' END, CASE WHEN c AND wip THEN 'WIP' END,
  CASE WHEN NOT c AND ext <> '.js' AND regexp_matches(content, '^\\s*pass\\s*$') THEN 'pass' END, CASE WHEN NOT c AND ext <> '.js' AND contains(content, 'NotImplementedError') THEN 'NotImplementedError' END,
  CASE WHEN c AND NOT wip AND regexp_matches(content, '(?i)in a real') THEN 'in a real' END, CASE WHEN c AND NOT wip AND regexp_matches(content, '(?i)for now') THEN 'for now' END, CASE WHEN c AND NOT wip AND regexp_matches(content, '(?i)simplified') THEN 'simplified' END,
  CASE WHEN c AND NOT wip AND regexp_matches(content, '(?i)placeholder') AND NOT regexp_matches(content, '{EXCLUDED}') THEN 'placeholder' END,
  CASE WHEN ext <> '.js' AND contains(content, 'def ') AND contains(content, 'pass') THEN 'One-line stub' END], lambda x: x IS NOT NULL)) AS subtype FROM m)
SELECT doc_id, line, CASE subtype WHEN 'WIP' THEN 'Worklog' WHEN 'One-line stub' THEN 'Improper Implementation' ELSE 'Incomplete/Improper' END AS type, subtype FROM t
""")
def line_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The static scan of documents as files of four kinds, one of which has a parser for stubs."""
    m, c = F.col("line") % 8, F.col("content")
    kind = (F.col("doc_id") % 4).cast("int")
    p = F.array(*map(F.lit, MARKS))[kind]
    said = (
        F.when(m == 1, F.concat(F.lit("  "), p, F.lit(" TODO "), c)).when(m == 2, F.concat(F.lit("x = 1 "), p, F.lit(" FIXME "), c)).when(m == 3, F.concat(p, F.lit(" wip placeholder"))).when(m == 4, "  pass")
        .when(m == 5, "raise NotImplementedError(1)").when(m == 6, F.concat(p, F.lit(" a placeholder_x, Simplified for now"))).when(m == 7, "def f(): pass").otherwise(c)
    )
    rows = doc_lines(spark, sf_dir).select("doc_id", "line", said.alias("content"))
    path = F.concat(F.lit("f"), F.array(*map(F.lit, [".py", ".js", ".sql", ".md"]))[kind])
    return extract.scan_lines(rows, path, parsed=(".js",)).drop("content")


@query(f"""
WITH {LINES}, k AS (SELECT doc_id, line, CASE line % 5 WHEN 0 THEN 'x = 1  # TODO ' || content WHEN 1 THEN '# NOTE: ' || content WHEN 2 THEN CASE WHEN doc_id % 3 = 0 THEN '# STATION:BEGIN' ELSE '# plain ' || content END WHEN 3 THEN CASE WHEN doc_id % 2 = 0 THEN '# STATION:END' ELSE 'y = 2' END ELSE content END AS content FROM l),
b AS (SELECT *, sum(CASE WHEN contains(content, 'STATION:BEGIN') THEN 1 ELSE 0 END) OVER w > sum(CASE WHEN contains(content, 'STATION:END') THEN 1 ELSE 0 END) OVER w OR contains(content, 'STATION:END') AS silent FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY line)),
c AS (SELECT doc_id, line, regexp_extract(content, '#\\s*(.*)$', 1) AS body FROM b WHERE NOT silent AND regexp_matches(content, '(^|\\s)#\\s*\\S'))
SELECT doc_id, line, substr(body, 1, 80) AS preview, CASE WHEN regexp_matches(body, '(?i)\\bTODO\\b') THEN 'TODO' WHEN regexp_matches(body, '(?i)\\bFIXME\\b') THEN 'FIXME' WHEN regexp_matches(body, '(?i)\\bWIP\\b') THEN 'WIP' WHEN regexp_matches(body, '(?i)\\bHACK\\b') THEN 'HACK' WHEN regexp_matches(body, '(?i)\\bXXX\\b') THEN 'XXX' WHEN regexp_matches(body, '(?i)\\bSTUB\\b') THEN 'STUB' WHEN regexp_matches(body, '(?i)\\bNOQA\\b') THEN 'NOQA' WHEN regexp_matches(body, '(?i)\\bTYPE:') THEN 'TYPE:' WHEN regexp_matches(body, '(?i)\\bNOTE:') THEN 'NOTE:' END AS subtype, CASE WHEN regexp_matches(body, '(?i)\\bTODO\\b') THEN 'incomplete' WHEN regexp_matches(body, '(?i)\\bFIXME\\b') THEN 'incomplete' WHEN regexp_matches(body, '(?i)\\bWIP\\b') THEN 'incomplete' WHEN regexp_matches(body, '(?i)\\bHACK\\b') THEN 'incomplete' WHEN regexp_matches(body, '(?i)\\bXXX\\b') THEN 'incomplete' WHEN regexp_matches(body, '(?i)\\bSTUB\\b') THEN 'incomplete' WHEN regexp_matches(body, '(?i)\\bNOQA\\b') THEN 'audit' WHEN regexp_matches(body, '(?i)\\bTYPE:') THEN 'audit' WHEN regexp_matches(body, '(?i)\\bNOTE:') THEN 'audit' END AS tier FROM c
""")
def comment_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, c = F.col("line") % 5, F.col("content")
    marked = (
        F.when(m == 0, F.concat(F.lit("x = 1  # TODO "), c)).when(m == 1, F.concat(F.lit("# NOTE: "), c))
        .when(m == 2, F.when(F.col("doc_id") % 3 == 0, F.lit("# STATION:BEGIN")).otherwise(F.concat(F.lit("# plain "), c)))
        .when(m == 3, F.when(F.col("doc_id") % 2 == 0, F.lit("# STATION:END")).otherwise(F.lit("y = 2"))).otherwise(c)
    )
    return extract.comments(doc_lines(spark, sf_dir).withColumn("content", marked), "#", "doc_id")


ANCHORS = f"""
{LINES}, g AS (SELECT doc_id, share, floor((max(line) - 1) * share / 100 + 0.5) + 1 AS goal FROM l, (SELECT unnest([25, 50, 75]) AS share) GROUP BY doc_id, share),
a AS (SELECT l.doc_id, g.share, arg_min(l.line, {{'d': abs(l.line - g.goal), 'l': -l.line}}) AS line FROM l JOIN g ON l.doc_id = g.doc_id AND abs(l.line - g.goal) <= 10 WHERE trim(l.content, ' ') <> '' GROUP BY ALL)
"""


@query(f"WITH {ANCHORS} SELECT doc_id, share, line FROM a")
def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.anchors(doc_lines(spark, sf_dir))


@query(f"""
WITH {LINES}, gone AS (SELECT doc_id, line FROM l WHERE length(content) % 7 = 3), n AS (SELECT l.doc_id, l.line, (SELECT count(*) FROM gone g WHERE g.doc_id = l.doc_id AND g.line < l.line) AS before, l.line IN (SELECT g.line FROM gone g WHERE g.doc_id = l.doc_id) AS self FROM l)
SELECT doc_id, line, CASE WHEN NOT self THEN line - before END AS new_line FROM n
""")
def line_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = doc_lines(spark, sf_dir)
    return extract.shift_lines(l, l.where(F.length("content") % 7 == 3))


@query(f"""
WITH {LINES}, pt AS (SELECT DISTINCT doc_id, line AS old, line + line % 3 AS new FROM l WHERE line % 6 = 1), x AS (SELECT l.doc_id, l.line, max(p.old) AS lo, min(q.old) AS hi FROM l LEFT JOIN pt p ON p.doc_id = l.doc_id AND p.old <= l.line LEFT JOIN pt q ON q.doc_id = l.doc_id AND q.old >= l.line GROUP BY 1, 2),
s AS (SELECT x.*, p.new - p.old AS sp, q.new - q.old AS sq FROM x LEFT JOIN pt p ON p.doc_id = x.doc_id AND p.old = x.lo LEFT JOIN pt q ON q.doc_id = x.doc_id AND q.old = x.hi)
SELECT doc_id, line, CAST(line + round_even(CASE WHEN sp IS NULL AND sq IS NULL THEN 0 WHEN sp IS NULL THEN sq WHEN sq IS NULL THEN sp ELSE sp + (sq - sp) * (line - lo) / greatest(hi - lo, 1) END, 0) AS INT) AS new_line FROM s
""")
def line_recover(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = doc_lines(spark, sf_dir)
    points = l.where("line % 6 = 1").select("doc_id", F.col("line").alias("old"), (F.col("line") + F.col("line") % 3).alias("new"))
    return extract.recover_lines(l.select("doc_id", "line"), points)


@query("SELECT source AS module, count(*) AS files, count(l.doc_id) AS covered, round(100.0 * count(l.doc_id) / count(*), 4) AS coverage, string_agg(CASE WHEN l.doc_id IS NULL THEN CAST(d.doc_id AS VARCHAR) END, ',' ORDER BY d.doc_id) AS gaps FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source")
def doc_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a label, by module, and the list of those without."""
    d = lift.table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("module"))
    l = lift.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("l_id"))
    j = d.join(l, d["doc_id"] == l["l_id"], "left")
    gaps = F.transform(F.array_sort(F.collect_list(F.when(F.col("l_id").isNull(), F.col("doc_id")))), lambda x: x.cast("string"))
    out = j.groupBy("module").agg(F.count(F.lit(1)).alias("files"), F.count("l_id").alias("covered"), gaps.alias("g"))
    return out.select("module", "files", "covered", F.round(100.0 * F.col("covered") / F.col("files"), 4).alias("coverage"), F.when(F.size("g") > 0, F.array_join("g", ",")).alias("gaps"))


@query("SELECT source, lang, count(*) AS n, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang) AS rank FROM documents GROUP BY 1, 2 QUALIFY rank <= 3")
def top_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent names of each module, by count then name."""
    n = lift.table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "lang")).cast("long")).where("rank <= 3")


@query(f"""
WITH {LINES}, r AS (SELECT doc_id, CAST(line + (line * 7 + doc_id) % 11 - 5 AS INT) AS line, '  ' || content AS anchor FROM l WHERE line % 3 = 0 UNION ALL SELECT doc_id, 5, 'nowhere at all' FROM documents UNION ALL SELECT doc_id, 3, ' ' FROM documents),
near AS (SELECT r.doc_id, r.line, r.anchor, arg_min(l.line, {{'d': abs(l.line - r.line), 'l': -l.line}}) AS found FROM r JOIN l ON l.doc_id = r.doc_id AND regexp_replace(l.content, '^\\s+|\\s+$', '', 'g') = regexp_replace(r.anchor, '^\\s+|\\s+$', '', 'g') WHERE regexp_replace(r.anchor, '^\\s+|\\s+$', '', 'g') <> '' GROUP BY ALL)
SELECT r.doc_id, r.line, r.anchor, CAST(found AS INT) AS found FROM r LEFT JOIN near ON near.doc_id = r.doc_id AND near.line = r.line AND near.anchor = r.anchor
""")
def anchor_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third line looked for from where it does not stand; lines that documents repeat are found nearest."""
    lines = doc_lines(spark, sf_dir)
    moved = (F.col("line") + (F.col("line") * 7 + F.col("doc_id")) % 11 - 5).cast("int")
    records = lines.where("line % 3 = 0").select("doc_id", moved.alias("line"), F.concat(F.lit("  "), "content").alias("anchor"))
    d = lift.table(spark, sf_dir, "documents")
    records = records.unionByName(d.select("doc_id", F.lit(5).alias("line"), F.lit("nowhere at all").alias("anchor"))).unionByName(d.select("doc_id", F.lit(3).alias("line"), F.lit(" ").alias("anchor")))
    return extract.nearest_anchors(records, lines)


def rerank_cap(length: int) -> int:
    """Texts of a length that 4 GB hold at once, 50 at most."""
    return max(1, min(50, int((4.0 - 0.5) // ((30 + length / 1000 * 120) / 1024))))


CAP = "CAST(greatest(1, least(50, floor(3.5 / ((30 + {x} / 1000 * 120) / 1024)))) AS BIGINT)"


@query(f"""
WITH RECURSIVE i AS (SELECT source AS grp, doc_id AS id, CAST(floor(length(text) / 4) AS BIGINT) AS length, row_number() OVER (PARTITION BY source ORDER BY floor(length(text) / 4), doc_id) - 1 AS rank, count(*) OVER (PARTITION BY source) AS n FROM documents),
t AS (SELECT i.grp, i.rank AS s, least(i.rank + {CAP.format(x='i.length')}, i.n) AS e FROM i),
step AS (SELECT t.grp, s, least(e, s + {CAP.format(x='last.length')}) AS e FROM t JOIN i last ON last.grp = t.grp AND last.rank = t.e - 1),
b AS (SELECT grp, 0::BIGINT AS batch, s, e FROM step WHERE s = 0 UNION ALL SELECT step.grp, b.batch + 1, step.s, step.e FROM b JOIN step ON step.grp = b.grp AND step.s = b.e)
SELECT i.grp, i.id, i.length, b.batch FROM i JOIN b ON b.grp = i.grp AND i.rank >= b.s AND i.rank < b.e
""")
def batch_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each source in batches for a model of 4 GB."""
    d = lift.table(spark, sf_dir, "documents")
    return batches.pack_by_length(d.select(F.col("source").alias("grp"), F.col("doc_id").alias("id"), text.tokens(F.col("text")).cast("long").alias("length")), rerank_cap)
