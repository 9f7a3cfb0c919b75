"""Repeated runs of lines by distributed prefix doubling (operator 9, DataFrame functions only).

The lines that hold a word are a document's sequence. Each suffix of a
sequence gets a name: of all suffixes that agree on its first d lines, the
place (document, ordinal) of the earliest. Doubling names pairs of names d
apart and so covers 2d lines, until no name is shared; a suffix that shares its
name with none drops out, since nothing longer can be shared. Naming needs one
aggregation that combines on the map side and one join whose hot keys Spark can
split. No join is broadcast: what stands on either side grows with the input. Suffixes with equal names at depth d are a longest-common-prefix
interval of value d or more; names nest from depth to depth, so they order the
suffixes as a suffix array does, under first occurrence instead of collation.

A suffix not named after itself is a later copy. From the deepest interval in
which it is one, it is held against that interval's first member: the tables of
names, from deep to shallow, add up the exact length of their common prefix.
Where the lines before the two are alike too, the run belongs to the suffix
before; what remains are runs that neither end can extend. Runs of
``min_lines`` lines, or single lines of ``long_line`` characters, are deleted.

Defined results: null text stays null, with no lines; lines without a word are
never part of a run and stay; of equal documents the smallest id keeps its
lines; rows repeated with the same id and text count once and get the same
result each; a text of any length is one sequence; an empty table gives no
rows. ``n_runs`` counts the stretches of deleted lines, ``longest_run`` is the
longest common prefix found. Lines are compared by two hashes of 64 bits with
different seeds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.common import shuffled, spool, table

#: Runs of so many lines go, and single lines of so many characters.
MIN_LINES, LONG_LINE = 2, 200
WORD = r"[^\x20\x09-\x0D]"
PLACE = ["doc", "version", "ord"]
PRIME = 0x9E3779B1


def _sequence(text: Column) -> Column:
    """The lines that hold a word."""
    return F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))


def suffixes(docs: DataFrame, long_line: int) -> DataFrame:
    """doc, version, ord, line ids a and b, whether the line is a long one."""
    lines = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("version"), F.posexplode(_sequence(F.col("text"))).alias("ord", "line"))
    return lines.select(*PLACE, F.xxhash64("line").alias("a"), F.xxhash64(F.lit(PRIME), "line", F.length("line")).alias("b"), (F.length("line") >= long_line).alias("long"))


def named(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows whose keys are shared, with name: the earliest place of all rows with equal keys."""
    groups = rows.groupBy(*keys).agg(F.min(F.struct(*PLACE)).alias("name"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    # As a table of its own, so that the join is one of two plain exchanges, whose hot keys can be split.
    groups = spool(groups.select(*(F.col(k).alias(f"g_{k}") for k in keys), "name"), "names")
    return rows.join(shuffled(groups), [rows[k] == groups[f"g_{k}"] for k in keys]).select(*PLACE, groups["name"], *(["long"] if "long" in rows.columns else []))


def deepened(names: DataFrame, step: int) -> DataFrame:
    """Names of ``step`` more lines than ``names`` has, of suffixes whose line ``step`` lines on has a name too."""
    there = Window.partitionBy("doc", "version").orderBy("ord").rangeBetween(step, step)
    pairs = names.select(*PLACE, F.col("name").alias("here"), F.max("name").over(there).alias("beyond")).where("beyond IS NOT NULL")
    return named(pairs, ["here", "beyond"])


def intervals(docs: DataFrame, min_lines: int, long_line: int) -> list[tuple[int, DataFrame]]:
    """(depth, names at that depth) until no name is shared; ``min_lines`` is among the depths."""
    names = spool(named(spool(suffixes(docs, long_line), "lines"), ["a", "b"]).dropDuplicates(PLACE), "depth")
    out, depth = [], 1
    while not names.isEmpty():
        out.append((depth, names))
        step = min(depth, min_lines - depth) if depth < min_lines else depth
        names = spool(deepened(names.drop("long"), step), "depth")
        depth += step
    return out


def _at(names: DataFrame, prefix: str) -> DataFrame:
    return names.select(*(F.col(c).alias(f"{prefix}_{c}") for c in PLACE), F.col("name").alias(f"{prefix}_name"))


def later_runs(docs: DataFrame, min_lines: int, long_line: int) -> DataFrame:
    """doc, version, ord, size: runs of lines that stand at an earlier place too, as far as both go on alike to either side."""
    levels = intervals(docs, min_lines, long_line)
    if not levels:
        return docs.where(F.lit(False)).select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("version"), F.lit(0).alias("ord"), F.lit(0).alias("size"))
    later = [x.where(F.col("name") != F.struct(*PLACE)).select(*PLACE, F.lit(d).alias("size"), "name", F.col("long") if d == 1 else F.lit(False).alias("long")) for d, x in levels]
    deepest = later[0]
    for x in later[1:]:
        deepest = deepest.unionByName(x)
    deepest = deepest.groupBy(*PLACE).agg(F.max_by(F.struct("size", "name"), "size").alias("top"), F.max("long").alias("long")).select(*PLACE, "top.size", "top.name", "long")
    before = Window.partitionBy("doc", "version").orderBy("ord").rangeBetween(-1, -1)
    follows = F.max("name").over(before) == F.struct(F.col("name.doc"), F.col("name.version"), F.col("name.ord") - 1)
    starts = spool(deepest.withColumn("inner", F.coalesce(follows, F.lit(False))).where(f"long OR NOT inner AND (size > 1 OR {min_lines} = 1)").drop("inner"), "starts")
    runs = starts.where(F.col("size") == levels[-1][0])
    for depth, names in reversed(levels[:-1]):  # a row joins in at the depth below its own
        here, there = _at(names, "h"), _at(names, "t")
        runs = runs.join(shuffled(here), F.col("doc").eqNullSafe(F.col("h_doc")) & (F.col("version") == F.col("h_version")) & (F.col("ord") + F.col("size") == F.col("h_ord")), "left")
        same = (F.col("h_name") == F.col("t_name")) & F.col("name.doc").eqNullSafe(F.col("t_doc")) & (F.col("name.version") == F.col("t_version")) & (F.col("name.ord") + F.col("size") == F.col("t_ord"))
        runs = runs.join(shuffled(there), same, "left").select(*PLACE, F.when(F.col("t_version").isNotNull(), F.col("size") + depth).otherwise(F.col("size")).alias("size"), "name", "long")
        # A plan for each level: one of all levels, planned anew after each exchange, is held by the driver again and again.
        runs = spool(runs.unionByName(starts.where(F.col("size") == depth)), "runs")
    return runs.where((F.col("size") >= min_lines) | F.col("long")).select(*PLACE, "size")


def runs(docs: DataFrame, min_lines: int, long_line: int) -> DataFrame:
    """r_doc, r_version, runs array<struct<first,last>> in ordinals that do not touch, longest: per document."""
    found = later_runs(docs, min_lines, long_line)
    per_doc = found.groupBy(F.col("doc").alias("r_doc"), F.col("version").alias("r_version")).agg(F.array_sort(F.collect_list(F.struct(F.col("ord").alias("first"), (F.col("ord") + F.col("size") - 1).alias("last")))).alias("found"), F.max("size").alias("longest"))
    run = "struct<first:int,last:int>"
    merged = F.aggregate(
        "found",
        F.struct(F.expr(f"cast(array() as array<{run}>)").alias("done"), F.expr(f"cast(null as {run})").alias("open")),
        lambda s, x: F.when(s["open"].isNull(), F.struct(s["done"].alias("done"), x.alias("open")))
        .when(x["first"] <= s["open"]["last"] + 1, F.struct(s["done"].alias("done"), F.struct(s["open"]["first"].alias("first"), F.greatest(s["open"]["last"], x["last"]).alias("last")).alias("open")))
        .otherwise(F.struct(F.concat(s["done"], F.array(s["open"])).alias("done"), x.alias("open"))),
        lambda s: F.concat(s["done"], F.array(s["open"])),
    )
    return per_doc.select("r_doc", "r_version", merged.alias("runs"), "longest")


def _marked(docs: DataFrame, min_lines: int, long_line: int, id_col: str, text_col: str) -> DataFrame:
    """text (what is kept), n_lines, n_removed, n_runs, longest_run, rest (all columns but the text)."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("version"), F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text_col)).alias("rest"))
    found = runs(rows.select("doc_id", "text"), min_lines, long_line)
    joined = rows.join(shuffled(found), rows["doc_id"].eqNullSafe(found["r_doc"]) & (rows["version"] == found["r_version"]), "left")
    # All lines, and the places among them of those that hold a word.
    lines = F.split("text", "\n", -1)
    places = F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(WORD), i)), lambda i: i.isNotNull())
    drop = F.flatten(F.transform("runs", lambda r: F.slice(F.col("places"), r["first"] + 1, r["last"] - r["first"] + 1)))
    cut = joined.withColumn("lines", lines).withColumn("places", places)
    kept = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), drop), lambda i: F.get("lines", i)), "\n")
    size = lambda r: r["last"] - r["first"] + 1
    return cut.select(
        F.when(F.col("runs").isNull(), F.col("text")).otherwise(kept).alias("text"),
        F.when(F.col("text").isNull(), 0).otherwise(F.size("places")).cast("long").alias("n_lines"),
        F.coalesce(F.aggregate("runs", F.lit(0), lambda n, r: n + size(r)), F.lit(0)).cast("long").alias("n_removed"),
        F.when(F.col("runs").isNull(), 0).otherwise(F.size("runs")).cast("long").alias("n_runs"),
        F.coalesce("longest", F.lit(0)).cast("long").alias("longest_run"),
        "rest",
    )


def dedup(docs: DataFrame, min_lines: int = MIN_LINES, long_line: int = LONG_LINE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text (what is kept), n_lines, n_removed, n_runs, longest_run."""
    out = _marked(docs, min_lines, long_line, id_col, text_col)
    return out.select(F.col(f"rest.`{id_col}`").alias("doc_id"), "text", "n_lines", "n_removed", "n_runs", "longest_run")


def clean(docs: DataFrame, min_lines: int = MIN_LINES, long_line: int = LONG_LINE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without later copies of runs; documents that lose every line are left out."""
    out = _marked(docs, min_lines, long_line, id_col, text_col).where("n_removed = 0 OR n_removed < n_lines")
    return out.select(*(F.col("text").alias(c) if c == text_col else F.col(f"rest.`{c}`") for c in docs.columns))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", "n_runs", "longest_run", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


#: Depths that the SQL below goes through; a longer run would be cut there, in ``longest_run`` alone.
SQL_DEPTHS = [1 << i for i in range(14)]


def _sql() -> str:
    """The same rows by window functions over all suffixes; common prefixes by comparing lists of lines."""
    deeper = [
        f"""l{2 * d} AS (
  SELECT doc_id, ord, place, min(place) OVER (PARTITION BY name, beyond) AS name
  FROM (SELECT doc_id, ord, place, name, lead(name, {d}) OVER (PARTITION BY doc_id ORDER BY ord) AS beyond FROM l{d}) WHERE beyond IS NOT NULL
)"""
        for d in SQL_DEPTHS[:-1]
    ]
    later = " UNION ALL ".join(f"SELECT doc_id, ord, place, name, {d} AS depth FROM l{d} WHERE name <> place" for d in SQL_DEPTHS)
    return rf"""
WITH ex AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents WHERE text IS NOT NULL
), nb AS (
  SELECT doc_id, line, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS ord, row_number() OVER (ORDER BY doc_id, pos) AS place
  FROM ex WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), l1 AS (
  SELECT doc_id, ord, place, min(place) OVER (PARTITION BY line) AS name FROM nb
), {", ".join(deeper)}, later AS ({later}), deepest AS (
  SELECT doc_id, ord, place, arg_max(name, depth) AS name FROM later GROUP BY doc_id, ord, place
), seqs AS (
  SELECT doc_id, list(line ORDER BY ord) AS lines FROM nb GROUP BY doc_id
), alike AS (
  SELECT d.doc_id, d.ord, a.lines[d.ord] AS line, [x[1] IS NOT DISTINCT FROM x[2] FOR x IN list_zip(a.lines[d.ord:], b.lines[o.ord:])] AS same
  FROM deepest d JOIN nb o ON o.place = d.name JOIN seqs a ON a.doc_id = d.doc_id JOIN seqs b ON b.doc_id = o.doc_id
), runs AS (
  SELECT doc_id, ord, coalesce(list_position(same, false) - 1, len(same)) AS size FROM alike
  WHERE coalesce(list_position(same, false) - 1, len(same)) >= {MIN_LINES} OR length(line) >= {LONG_LINE}
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(ord, ord + size)) AS ord FROM runs
), islands AS (
  SELECT doc_id, grp, count(*) AS len FROM (SELECT doc_id, ord - row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS grp FROM gone) GROUP BY doc_id, grp
), run_stats AS (
  SELECT doc_id, count(*) AS n_runs, sum(len) AS n_removed FROM islands GROUP BY doc_id
), longest AS (SELECT doc_id, max(size) AS longest_run FROM runs GROUP BY doc_id), kept AS (
  SELECT ex.doc_id, string_agg(ex.line, chr(10) ORDER BY ex.pos) AS text
  FROM ex LEFT JOIN nb ON nb.doc_id = ex.doc_id AND nb.pos = ex.pos LEFT JOIN gone ON gone.doc_id = nb.doc_id AND gone.ord = nb.ord
  WHERE gone.ord IS NULL GROUP BY ex.doc_id
), n AS (SELECT doc_id, count(*) AS n_lines FROM nb GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(r.n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(r.n_runs, 0) AS BIGINT) AS n_runs, CAST(coalesce(t.longest_run, 0) AS BIGINT) AS longest_run, sha256(coalesce(k.text, '')) AS kept_sha256
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN run_stats r ON r.doc_id = d.doc_id LEFT JOIN longest t ON t.doc_id = d.doc_id LEFT JOIN kept k ON k.doc_id = d.doc_id
"""


OP9_SQL = _sql()
