"""Paths, hashes and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: characters without width.
INVISIBLE = "[​‌‍⁠﻿]"


def normal_path(path: Column) -> Column:
    """Forward slashes, no invisible characters, ``.`` and ``..`` folded, no slash at the end."""
    clean = F.regexp_replace(F.regexp_replace(path, INVISIBLE, ""), r"\\", "/")
    parts = F.filter(F.split(clean, "/"), lambda p: (p != "") & (p != "."))
    folded = F.aggregate(parts, F.expr("cast(array() as array<string>)"), lambda a, p: F.when(p == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(p))))
    return F.concat(F.when(clean.startswith("/"), "/").otherwise(""), F.array_join(folded, "/"))


def relative(path: Column, root: Column) -> Column:
    return F.when(path == root, F.lit(".")).when(F.startswith(path, F.concat(root, F.lit("/"))), F.substr(path, F.length(root) + 2)).otherwise(path)


def under(path: Column, parent: Column) -> Column:
    """Strictly below ``parent``."""
    return F.startswith(path, F.concat(parent, F.lit("/")))


def parent(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]+$", 1)


# The mark of line comments by extension, # for all others; what ends a line; what a tool has written.
COMMENT_PREFIXES = {
    ".py": "#", ".js": "//", ".ts": "//", ".tsx": "//", ".jsx": "//", ".cs": "//", ".sql": "--", ".glsl": "//", ".hlsl": "//", ".wgsl": "//", ".md": "<!--",
}
LINE_END = r"\r\n|[\n\r\x0b\f\x1c-\x1e\x85\u2028\u2029]"
AUTO_TAG = "[AUTO]"
HEADER = "STATION_HEADER"


def extension(path: Column) -> Column:
    """The last suffix of a file's name, in lower case; '' without one."""
    return F.lower(F.regexp_extract(path, r"[^/\\]+(\.[^./\\]*)$", 1))


def comment_prefix(path: Column) -> Column:
    own = F.create_map(*(F.lit(x) for kv in COMMENT_PREFIXES.items() for x in kv))
    return F.coalesce(F.try_element_at(own, extension(path)), F.lit("#"))


def auto_mask(lines: Column, prefix: Column) -> Column:
    """For each line whether a tool wrote it: header blocks from mark to mark, and comments with the tag.

    Each line becomes a digit (1 opens, 2 closes, 3 carries the tag); a block is a stretch of that text, so that the
    state runs along the lines without a loop.
    """
    html = prefix == "<!--"
    lead = F.concat(F.lit(r"\Q"), prefix, F.lit(r"\E\s*(?:---\s*)?"))
    # Few lines hold a tool's word; patterns that follow the mark are compiled for each line that asks them.
    word = lambda x: F.contains(x, F.lit(HEADER))
    opens = lambda x: word(x) & F.regexp_like(x, F.concat(lead, F.lit(f"{HEADER}_START")))
    closes = lambda x: word(x) & F.when(html, x.rlike(rf"{HEADER}_END\s*(?:---\s*)?(?:\[AUTO\]\s*)?-->")).otherwise(F.regexp_like(x, F.concat(lead, F.lit(f"{HEADER}_END"))))
    tagged = lambda x: F.contains(x, F.lit(AUTO_TAG)) & F.startswith(F.regexp_replace(x, r"^\s+", ""), prefix)
    digits = F.array_join(F.transform(lines, lambda x: F.when(opens(x), "1").when(closes(x), "2").when(tagged(x), "3").otherwise("0")), "")
    parts = F.regexp_extract_all(digits, F.lit("(1[013]*2?|[23]|0+)"), F.lit(1))
    mask = F.array_join(F.transform(parts, lambda p: F.when(p.startswith("0"), p).otherwise(F.call_function("repeat", F.lit("1"), F.length(p)))), "")
    return F.transform(F.split(mask, ""), lambda c: c == "1")


def auto_lines(text: Column, path: Column) -> Column:
    """array<struct<line,auto>>: the lines with their ends, and whether a tool wrote them. The text is cut once."""
    lines = F.regexp_extract_all(text, F.lit(rf"([^\n\r\x0b\f\x1c-\x1e\x85\u2028\u2029]*(?:{LINE_END})|[^\n\r\x0b\f\x1c-\x1e\x85\u2028\u2029]+)"), F.lit(1))
    zipped = lambda x: F.arrays_zip(x.alias("line"), auto_mask(x, comment_prefix(path)).alias("auto"))
    return F.get(F.transform(F.array(lines), zipped), 0)


def without_auto(marked: Column, text: Column, preserve_lines: bool = True) -> Column:
    """The text of marked lines (see ``auto_lines``) without those that a tool wrote."""
    told = F.transform(marked, lambda z: F.when(z["auto"], "\n").otherwise(z["line"])) if preserve_lines else F.transform(F.filter(marked, lambda z: ~z["auto"]), lambda z: z["line"])
    return F.when(F.length(text) == 0, "").otherwise(F.array_join(told, ""))


def strip_auto(text: Column, path: Column, preserve_lines: bool = True) -> Column:
    """The text without what tools wrote; the lines go, or with ``preserve_lines`` become empty, so that numbers stay."""
    return without_auto(auto_lines(text, path), text, preserve_lines)


def _bare(s: Column) -> Column:
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def _normal_line(line: Column, prefix: Column) -> Column:
    """One space around a comment's mark; a mark after an odd number of quotes stands in a string and is left alone."""
    at = F.position(prefix, line)
    code, said = _bare(F.substr(line, F.lit(1), at - 1)), F.substr(line, at + F.length(prefix))
    even = lambda q: (F.length(F.substr(line, F.lit(1), at - 1)) - F.length(F.replace(F.substr(line, F.lit(1), at - 1), F.lit(q), F.lit("")))) % 2 == 0
    closed = F.regexp_like(said, F.lit(r"(?s)-->\s*$")) & (prefix == "<!--")
    inner = _bare(F.when(closed, F.regexp_replace(said, r"-->\s*$", "")).otherwise(said))
    mended = F.concat(F.when(code == "", prefix).otherwise(F.concat(code, F.lit(" "), prefix)), F.lit(" "), inner, F.when(closed, " -->").otherwise(""))
    touched = (at > 0) & ((prefix == "<!--") | (even("'") & even('"')))
    return _bare(F.when(touched, mended).otherwise(line))


def content_normal(text: Column, path: Column | None = None) -> Column:
    """Line ends, indentation, blank lines, the space around a comment's mark and, where a path is given, what tools wrote do not count."""
    prefix = F.lit("#") if path is None else comment_prefix(path)
    plain = F.regexp_replace(text, r"\r\n?", "\n")
    plain = plain if path is None else strip_auto(plain, path, preserve_lines=False)
    lines = F.transform(F.filter(F.transform(F.split(plain, LINE_END), _bare), lambda x: x != ""), lambda x: _normal_line(x, prefix))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def content_hash(text: Column, path: Column | None = None) -> Column:
    return F.sha2(content_normal(text, path), 256)


def blob_sha(data: Column) -> Column:
    """The SHA-1 that version control gives a file."""
    raw = F.encode(data, "utf-8")
    return F.sha1(F.concat(F.encode(F.concat(F.lit("blob "), F.octet_length(raw).cast("string")), "utf-8"), F.lit(bytearray(b"\0")), raw))


def sql_name(name: Column) -> Column:
    """The last dotted part without quotes, lower case."""
    return F.lower(F.regexp_replace(F.element_at(F.split(F.trim(name), r"\."), -1), r"^[\"'`\[]|[\"'`\]]$", ""))


def tokens(text: Column) -> Column:
    return F.floor(F.length(text) / 4)


def duration(seconds: Column) -> Column:
    s = seconds.cast("long")
    return F.when(s < 60, F.format_string("%ds", s)).when(s < 3600, F.format_string("%dm %ds", F.floor(s / 60), s % 60)).otherwise(F.format_string("%dh %dm", F.floor(s / 3600), F.floor((s % 3600) / 60)))
