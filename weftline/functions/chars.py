"""The alphabet of dependency characters: priority, reciprocity, roles, score bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Priority of each dependency character; anything else has 0.
PRIORITY = {"x": 6, "<": 5, ">": 5, "n": 5, "d": 4, "S": 3, "s": 2, "p": 1, "o": 1, "-": 0, " ": 0}
#: Context tiers of positive characters.
TIER = {"x": 1, "<": 2, ">": 2, "d": 3, "S": 4, "s": 5}
DOC_EXTENSIONS = ("md", "rst", "txt")
# File type by extension.
FILE_TYPES = {
    "py": "py", "js": "js", "ts": "js", "jsx": "js", "tsx": "js", "mjs": "js", "cjs": "js", "md": "md", "rst": "md", "html": "html", "htm": "html", "css": "css", "sql": "sql", "json": "json", "svelte": "svelte", "rs": "rs", "txt": "txt", "ipynb": "ipynb",
}


def lookup(c: Column, values: dict, default: object) -> Column:
    """A literal map as CASE; stays inside generated code."""
    out = None
    for k, v in values.items():
        out = F.when(c == k, v) if out is None else out.when(c == k, v)
    return out.otherwise(default)


def priority(ch: Column) -> Column:
    return lookup(ch, PRIORITY, 0)


def tier(ch: Column) -> Column:
    return lookup(ch, TIER, None)


def reciprocal(ch: Column) -> Column:
    return F.when(ch == "<", ">").when(ch == ">", "<").when(ch == "x", "x")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def file_type(path: Column) -> Column:
    return lookup(extension(path), FILE_TYPES, "generic")


def role(path: Column) -> Column:
    return F.when(extension(path).isin(*DOC_EXTENSIONS), "doc").otherwise("code")


def direction(source_role: Column, target_role: Column) -> Column:
    """A document that describes code is needed by it; equals depend on each other."""
    return F.when((source_role == "doc") & (target_role == "code"), ">").when((source_role == "code") & (target_role == "doc"), "<").otherwise("x")


def band(score: Column, source_role: Column, target_role: Column, verified: float = 0.9, strong: float = 0.7, weak: float = 0.65) -> Column:
    """The character that a similarity earns; null below all bands."""
    return F.when(score >= verified, direction(source_role, target_role)).when(score >= strong, "S").when(score >= weak, "s")
