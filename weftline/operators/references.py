"""Links of documents, pages and style sheets resolved to files: a few candidates each, in order, joined to what is there."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators import extract
from weftline.operators.scripts import folder, normal

# What leads out of a project, and what a link without an extension may mean, in order.
OUTSIDE = r"^(#|mailto:|tel:|http:|https:|//|data:)"
PAGE_PROBES = ["", ".md", ".rst", "/index.md", "/README.md"]


def local(url: Column) -> Column:
    """The path of a local reference, without fragment and query; null for all others."""
    path = F.regexp_replace(url, r"[#?].*$", "")
    return F.when(url.isNotNull() & ~url.rlike(OUTSIDE) & (path != ""), path)


def _first(tried: DataFrame, files: DataFrame, ch: str) -> DataFrame:
    """tried: src, url, rank, try -> src, dst, ch: the first candidate of each reference that is a file."""
    known = files.select(F.col("path").alias("file")).distinct()
    hit = tried.join(known, tried["try"] == known["file"]).groupBy("src", "url").agg(F.min_by("file", "rank").alias("dst"))
    return hit.where("src <> dst").select("src", "dst", F.lit(ch).alias("ch")).distinct()


def _beside(src: Column, path: Column) -> Column:
    return normal(F.concat(folder(src), F.lit("/"), path))


def page_edges(links: DataFrame, files: DataFrame) -> DataFrame:
    """links (path, url) of Markdown files -> src, dst, ch ``d``. Absolute paths lead nowhere; a link without an extension may leave it out, or mean a folder's page."""
    rows = links.select(F.col("path").alias("src"), "url", local(F.col("url")).alias("to")).where("to IS NOT NULL AND NOT startswith(to, '/')").distinct()
    base = _beside(F.col("src"), F.col("to"))
    rows = rows.select("src", "url", base.alias("base"))
    bare = ~F.col("base").rlike(r"[^/.][^/]*\.[^/.]*$")
    tried = rows.select("src", "url", F.posexplode(F.when(bare, F.transform(F.array(*map(F.lit, PAGE_PROBES)), lambda p: F.concat("base", p))).otherwise(F.array("base"))).alias("rank", "try"))
    return _first(tried, files, "d")


def html_edges(refs: DataFrame, files: DataFrame, roots: Sequence[str] = ("/",)) -> DataFrame:
    """refs (path, url) of pages -> src, dst, ch ``d``. Absolute paths are looked for below each root in order."""
    rows = refs.select(F.col("path").alias("src"), "url", local(F.col("url")).alias("to")).where("to IS NOT NULL").distinct()
    below = F.array(*(normal(F.concat(F.lit(f"{r}/"), F.col("to"))) for r in roots))
    tried = rows.select("src", "url", F.posexplode(F.when(F.col("to").startswith("/"), below).otherwise(F.array(_beside(F.col("src"), F.col("to"))))).alias("rank", "try"))
    return _first(tried, files, "d")


def css_edges(imports: DataFrame, files: DataFrame) -> DataFrame:
    """imports (path, url) of style sheets -> src, dst, ch ``<``."""
    rows = imports.select(F.col("path").alias("src"), "url", local(F.regexp_replace("url", "^['\"]+|['\"]+$", "")).alias("to")).where("to IS NOT NULL AND NOT startswith(to, '/')").distinct()
    return _first(rows.select("src", "url", F.lit(0).alias("rank"), _beside(F.col("src"), F.col("to")).alias("try")), files, "<")


def edges(files: DataFrame, roots: Sequence[str] = ("/",)) -> DataFrame:
    """files (path, content) -> src, dst, ch of all Markdown, HTML and CSS files."""
    of = lambda kinds: files.where(F.lower("path").rlike(rf"\.({kinds})$"))
    links = extract.markdown(of("md|rst"), "path", "content").where("kind = 'link'").select("path", F.col("value").alias("url"))
    refs = extract.html_references(of("html|htm"), "path", "content").select("path", "url")
    imports = extract.css_imports(of("css").withColumnRenamed("path", "id"), "id", "content").select(F.col("id").alias("path"), F.col("path").alias("url"))
    return page_edges(links, files).unionByName(html_edges(refs, files, roots)).unionByName(css_edges(imports, files))
