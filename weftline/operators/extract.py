"""Rows out of texts: references, headers, keys, names, comments, findings. Native expressions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import text

# Attributes that refer to other files, by element.
HTML_REFERENCES = (("a", "href", "link"), ("link", "href", "stylesheet"), ("script", "src", "script"), ("img", "src", "image"))
# Line patterns of the static scan (label, pattern), those that look at comments only, those that silence
# all others of a comment, what is no placeholder, and the marks of comments by extension.
LINE_PATTERNS = (
    ("TODO", r"(?i)TODO"), ("FIXME", r"(?i)FIXME"), ("WIP", r"(?i)WIP"), ("pass", r"^\s*pass\s*$"), ("NotImplementedError", r"NotImplementedError"),
    ("in a real", r"(?i)in a real"), ("for now", r"(?i)for now"), ("simplified", r"(?i)simplified"), ("placeholder", r"(?i)placeholder"),
)
COMMENT_LABELS = ("TODO", "FIXME", "WIP", "in a real", "for now", "simplified", "placeholder")
ALONE = ("WIP",)
NO_PLACEHOLDER = r'(?i)_placeholder|placeholder_|sql\.Placeholder|placeholders\s*=|placeholder\s*=|placeholder\s*:|Placeholder\(\)|\.placeholder\.|"placeholder"'
COMMENT_MARKS = {
    ".py": "#", ".pyw": "#", ".js": "//", ".jsx": "//", ".ts": "//", ".tsx": "//", ".cs": "//", ".java": "//", ".cpp": "//", ".c": "//", ".h": "//", ".rs": "//", ".go": "//", ".swift": "//", ".kt": "//", ".sql": "--", ".lua": "--", ".rb": "#",
    ".sh": "#", ".bash": "#", ".zsh": "#", ".yaml": "#", ".yml": "#", ".toml": "#", ".ini": "#;", ".cfg": "#;", ".r": "#", ".glsl": "//", ".hlsl": "//", ".md": "<!--", ".txt": "#",
}
# Tags of comments in any letter case, first match wins, with their tier.
COMMENT_TAGS = (
    ("TODO", "incomplete"), ("FIXME", "incomplete"), ("WIP", "incomplete"), ("HACK", "incomplete"), ("XXX", "incomplete"), ("STUB", "incomplete"),
    ("NOQA", "audit"), ("TYPE:", "audit"), ("NOTE:", "audit"),
)


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, line (from 1), content."""
    return docs.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("p", "content")).select(id_col, (F.col("p") + 1).alias("line"), "content")


def _as(kind: str) -> Callable[[Column], Column]:
    return lambda u: F.struct(F.lit(kind).alias("kind"), u.alias("url"))


def html_references(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id, kind, url: local references, each once for a page."""
    found = [F.transform(F.regexp_extract_all(F.col(html_col), F.lit(rf"(?i)<{tag}\s+(?:[^>]*?\s+)?{attribute}=[\"']([^\"']+?)[\"']"), F.lit(1)), _as(kind)) for tag, attribute, kind in HTML_REFERENCES]
    rows = pages.select(id_col, F.explode(F.array_distinct(F.concat(*found))).alias("r")).select(id_col, "r.kind", "r.url")
    return rows.where(~F.col("url").rlike("^(https?:|mailto:|tel:|#|data:|javascript:)"))


def css_imports(texts: DataFrame, id_col: str, css_col: str) -> DataFrame:
    """id, path of ``@import`` rules."""
    found = F.regexp_extract_all(css_col, F.lit(r"""@import\s+(?:url\()?['"]?([^'")\s;]+)"""), F.lit(1))
    return texts.select(id_col, F.explode(found).alias("path")).where(~F.col("path").rlike("^https?:"))


def markdown(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, kind (header, link, image, fence), value, level."""
    t = F.col(text_col)
    headers = F.transform(F.regexp_extract_all(t, F.lit(r"(?m)^(#{1,6} +[^\n]+)"), F.lit(1)), lambda h: F.struct(F.lit("header").alias("kind"), F.regexp_replace(h, "^#+ +", "").alias("value"), F.length(F.regexp_extract(h, "^(#+)", 1)).alias("level")))
    each = lambda pattern, kind: F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(1)), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value"), F.lit(0).alias("level")))
    links = each(r"(?<!!)\[[^\]\n]*\]\(([^)\s]+)", "link")
    images = each(r"!\[[^\]\n]*\]\(([^)\s]+)", "image")
    fences = each(r"(?m)^```([A-Za-z0-9_+-]*)[^\n]*\n[\s\S]*?^```", "fence")
    rows = docs.select(id_col, F.explode(F.concat(headers, links, images, fences)).alias("x")).select(id_col, "x.kind", "x.value", "x.level")
    return rows.where(~((F.col("kind") == "link") & F.col("value").rlike("^(https?:|mailto:|tel:|#)")))


def json_keys(rows: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """id, key, value: top-level members of a JSON object as text."""
    return rows.select(id_col, F.explode(F.from_json(json_col, "map<string,string>")).alias("key", "value"))


def sql_tables(files: DataFrame) -> DataFrame:
    """path, kind (defined, referenced), name: tables that statements create or read."""
    from weftline.functions.text import sql_name

    plain = F.regexp_replace(F.regexp_replace("content", r"--[^\n]*", " "), r"(?s)/\*.*?\*/", " ")
    name = r"([\w.\"`\[\]]+)"
    get = lambda pattern, kind: F.transform(F.regexp_extract_all(plain, F.lit(pattern), F.lit(1)), lambda n: F.struct(F.lit(kind).alias("kind"), sql_name(n).alias("name")))
    defined = get(rf"(?i)\bcreate\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+)?(?:table|view)\s+(?:if\s+not\s+exists\s+)?{name}", "defined")
    read = get(rf"(?i)\b(?:from|join|references|into|update)\s+{name}", "referenced")
    return files.select("path", F.explode(F.array_distinct(F.concat(defined, read))).alias("t")).select("path", "t.kind", "t.name")


def sql_lineage(tables: DataFrame) -> DataFrame:
    """src, dst, ch: a file needs (<) the files that define what it reads, and is needed (>) by its own readers."""
    d = tables.where("kind = 'defined'").select(F.col("path").alias("dst"), "name")
    r = tables.where("kind = 'referenced'").select(F.col("path").alias("src"), "name")
    uses = r.join(d, "name").where("src <> dst").select("src", "dst").distinct()
    return uses.select("src", "dst", F.lit("<").alias("ch")).unionByName(uses.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(">").alias("ch")))


def scan_lines(rows: DataFrame, path: Column, parsed: tuple[str, ...] = ()) -> DataFrame:
    """id columns and line, content -> the same with type and subtype for each finding of a line.

    Patterns of COMMENT_LABELS look at comment lines, the others at code. A comment that shows one of ALONE says only
    that, as a Worklog. Files whose extension is in ``parsed`` leave stubs to their parser: no ``pass``, no
    NotImplementedError, no one-line stubs here.
    """
    content, ext = F.col("content"), text.extension(path)
    marks = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in COMMENT_MARKS.items() for x in kv)), F.regexp_extract(path, r"[^/]+(\.[^./]*)$", 1)), F.lit("#"))
    bare = F.regexp_replace(content, r"^\s+", "")
    comment = F.when(marks == "#;", bare.rlike("^[#;]")).otherwise(F.startswith(bare, marks))
    left = ext.isin(*parsed) if parsed else F.lit(False)
    alone = lambda label: F.when(F.lit(label in ALONE), F.lit(True)).otherwise(~content.rlike("|".join(f"(?:{p})" for name, p in LINE_PATTERNS if name in ALONE)))

    def holds(label: str, pattern: str) -> Column:
        hit = content.rlike(pattern) & (comment & alone(label) if label in COMMENT_LABELS else ~comment)
        if label in ("pass", "NotImplementedError"):
            hit = hit & ~left
        return hit & ~content.rlike(NO_PLACEHOLDER) if label == "placeholder" else hit

    found = lambda hit, kind, label: F.when(hit, F.struct(F.lit(kind).alias("type"), F.lit(label).alias("subtype")))
    every = [found(holds(label, p), "Worklog" if label in ALONE else "Incomplete/Improper", label) for label, p in LINE_PATTERNS]
    every.append(found(content.contains("def ") & content.contains("pass") & ~left, "Improper Implementation", "One-line stub"))
    return rows.select("*", F.explode(F.filter(F.array(*every), lambda x: x.isNotNull())).alias("f")).select("*", "f.type", "f.subtype").drop("f")


def comments(rows: DataFrame, mark: str, path_col: str) -> DataFrame:
    """path, line, preview, subtype, tier of comment lines; those inside STATION blocks are silent.

    A block opens at ``STATION:BEGIN`` and closes at ``STATION:END``; one that never closes silences the rest.
    """
    w = Window.partitionBy(path_col).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    opened = F.sum(F.when(F.col("content").contains("STATION:BEGIN"), 1).otherwise(0)).over(w)
    closed = F.sum(F.when(F.col("content").contains("STATION:END"), 1).otherwise(0)).over(w)
    body = F.regexp_extract("content", rf"{mark}\s*(.*)$", 1)
    subtype = tier = None
    for tag, level in COMMENT_TAGS:
        hit = body.rlike(rf"(?i)\b{tag}" + ("" if tag.endswith(":") else r"\b"))
        subtype = F.when(hit, tag) if subtype is None else subtype.when(hit, tag)
        tier = F.when(hit, level) if tier is None else tier.when(hit, level)
    found = rows.withColumn("silent", (opened > closed) | F.col("content").contains("STATION:END")).where(F.col("content").rlike(rf"(^|\s){mark}\s*\S"))
    return found.where("NOT silent").select(path_col, "line", F.substring(body, 1, 80).alias("preview"), subtype.alias("subtype"), tier.alias("tier"))


def essence(docs: DataFrame, header: Column, following: int = 3, id_col: str = "doc_id") -> DataFrame:
    """id, line, content, role: header lines and up to ``following`` lines after each. docs: id, line, content."""
    w = Window.partitionBy(id_col).orderBy("line")
    is_header = docs.withColumn("h", header)
    near = F.lit(False)
    for i in range(1, following + 1):
        near = near | F.coalesce(F.lag("h", i).over(w), F.lit(False))
    return is_header.withColumn("near", near).where("h OR near").select(id_col, "line", "content", F.when(F.col("h"), "header").otherwise("context").alias("role"))


def anchors(lines_: DataFrame, id_col: str = "doc_id", reach: int = 10) -> DataFrame:
    """id, share, line: the line nearest to 25, 50 and 75 per cent of a text that is not blank; later wins ties."""
    sized = lines_.groupBy(id_col).agg(F.max("line").alias("n"))
    goals = sized.select(F.col(id_col).alias("g_id"), F.explode(F.array(F.lit(25), F.lit(50), F.lit(75))).alias("share"), "n").withColumn("goal", F.floor((F.col("n") - 1) * F.col("share") / 100 + 0.5) + 1)
    full = lines_.where(F.trim("content") != "")
    near = full.join(goals, (full[id_col] == goals["g_id"]) & F.abs(F.col("line") - F.col("goal")).between(0, reach))
    return near.groupBy(id_col, "share").agg(F.min_by("line", F.struct(F.abs(F.col("line") - F.col("goal")), -F.col("line"))).alias("line"))


def shift_lines(records: DataFrame, removed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """records (id, line) with the line each has once the removed lines (id, line) are gone; null if it went itself.

    A running sum over both in order of line replaces a join by range.
    """
    both = records.select(id_col, "line", F.lit(0).alias("gone")).unionByName(removed.select(id_col, "line", F.lit(1).alias("gone")).distinct())
    w = Window.partitionBy(id_col).orderBy("line").rangeBetween(Window.unboundedPreceding, -1)
    before = both.withColumn("before", F.coalesce(F.sum("gone").over(w), F.lit(0))).withColumn("self", F.max("gone").over(Window.partitionBy(id_col, "line")))
    return before.where("gone = 0").select(id_col, "line", F.when(F.col("self") == 0, F.col("line") - F.col("before")).alias("new_line"))


def recover_lines(records: DataFrame, points: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """records (id, line), points (id, old, new) -> line moved by the shift interpolated between the points around it."""
    both = records.select(id_col, "line", F.lit(None).cast("int").alias("new")).unionByName(points.select(id_col, F.col("old").alias("line"), "new"))
    back = Window.partitionBy(id_col).orderBy("line").rangeBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(id_col).orderBy("line").rangeBetween(0, Window.unboundedFollowing)
    known = F.when(F.col("new").isNotNull(), F.struct("line", "new"))
    j = both.withColumn("p", F.last(known, True).over(back)).withColumn("q", F.first(known, True).over(ahead)).where("new IS NULL")
    p, q, line = F.col("p"), F.col("q"), F.col("line")
    shift_p, shift_q = p["new"] - p["line"], q["new"] - q["line"]
    between = shift_p + (shift_q - shift_p) * (line - p["line"]) / F.greatest(q["line"] - p["line"], F.lit(1))
    shift = F.when(p.isNull() & q.isNull(), 0.0).when(p.isNull(), shift_q).when(q.isNull(), shift_p).otherwise(between)
    return j.select(id_col, "line", (line + F.bround(shift)).cast("int").alias("new_line"))


def nearest_anchors(records: DataFrame, lines_: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """records (id, line, anchor) -> found: the line that holds the anchor nearest to the recorded one; the later of two as near.

    White space around lines and anchors does not count; an empty anchor is nowhere. Each record meets the last line
    of its text up to it and the first from it on, in one pass over the lines that hold the same.
    """
    bare = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    asked = records.select(id_col, F.col("line").alias("at"), bare(F.col("anchor")).alias("said"), "anchor", F.lit(None).cast("int").alias("here"))
    held = lines_.select(id_col, F.col("line").alias("at"), bare(F.col("content")).alias("said"), F.lit(None).cast("string").alias("anchor"), F.col("line").cast("int").alias("here"))
    wanted = asked.where("said <> ''").select(F.col(id_col).alias("w_id"), F.col("said").alias("w_said")).distinct()
    held = held.join(wanted, (held[id_col] == wanted["w_id"]) & (held["said"] == wanted["w_said"]), "left_semi")
    w = Window.partitionBy(id_col, "said").orderBy("at")
    both = asked.withColumn("asks", F.lit(True)).unionByName(held.withColumn("asks", F.lit(False)))
    both = both.withColumn("p", F.last("here", True).over(w.rangeBetween(Window.unboundedPreceding, 0))).withColumn("q", F.first("here", True).over(w.rangeBetween(0, Window.unboundedFollowing)))
    p, q, at = F.col("p"), F.col("q"), F.col("at")
    found = F.when(F.col("said") == "", None).when(q.isNull(), p).when(p.isNull() | (q - at <= at - p), q).otherwise(p)
    return both.where("asks").select(id_col, at.alias("line"), "anchor", found.alias("found"))
