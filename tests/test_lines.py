"""Hashes, blocks, line scans, anchors and batches, each against a plain walk over the lines."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from weftline.functions import text
from weftline.operators import batches, extract
from weftline.plans import nodes
from weftline.plans.texts import rerank_cap


def told(spark, rows, make):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, p string")
    return [r.v for r in df.select("i", make(F.col("t"), F.col("p")).alias("v")).orderBy("i").collect()]


def test_hash_cases(spark):
    """Line ends, indentation, comment spacing, marks in strings, HTML comments and blank lines."""
    rows = [("def foo():\n    x = 1\n    return x\n", ""), ("def foo():\r\n    x = 1\r\n    return x\r\n", ""), ("def foo():\r    x = 1\r    return x\r", ""), ("\tdef foo():\n\n\n\t\tx = 1\n\t\treturn x", "")]
    assert told(spark, rows, lambda t, p: text.content_normal(t)) == ["def foo():\nx = 1\nreturn x"] * 4
    assert len(set(told(spark, rows, lambda t, p: text.content_hash(t)))) == 1
    rows = [("x = 1 # some comment", "test.py"), ("x = 1      #   some comment", "test.py"), ("x = 1#some comment", "test.py")]
    assert told(spark, rows, text.content_normal) == ["x = 1 # some comment"] * 3
    rows = [('url = "http://example.com/test#anchor"\n# real comment', "test.py"), ("a //b", "dir.x/T.JS"), ("a //b", "t.py"), ("a --b", "t.sql"), ("it's #x", "t.py"), ("", "t.py"), (None, "t.py")]
    assert told(spark, rows, text.content_normal) == [rows[0][0], "a // b", "a //b", "a -- b", "it's #x", "", None]
    rows = [("<!--   some md comment   -->", "test.md"), ("<!--some md comment-->", "test.md"), ("  <!-- some md comment -->", "test.md"), ("text<!--open", "a.MD")]
    assert told(spark, rows, text.content_normal) == ["<!-- some md comment -->"] * 3 + ["text <!-- open"]


PYTHON = "# --- STATION_HEADER_START --- [AUTO]\n# ROLE:    Test.\n# LAYER:   Test.\n# --- STATION_HEADER_END --- [AUTO]\n\ndef hello():\n    return 'world'\n"


def test_block_cases(spark):
    keep = lambda t, p: text.strip_auto(t, p, True)
    drop = lambda t, p: text.strip_auto(t, p, False)
    rest = "\ndef hello():\n    return 'world'\n"
    assert told(spark, [(PYTHON, "test.py")], keep) == ["\n" * 4 + rest] and told(spark, [(PYTHON, "test.py")], drop) == [rest]
    rows = [
        ("// --- STATION_HEADER_START --- [AUTO]\n// ROLE: x\n// --- STATION_HEADER_END --- [AUTO]\n\nconsole.log('hello');\n", "test.js"),
        ("<!-- --- STATION_HEADER_START --- [AUTO]\nROLE: x\nCRCT_KEY:   1Ad8 [AUTO]\n--- STATION_HEADER_END --- [AUTO] -->\n\n# Title\n", "test.md"),
        ("# STATION_HEADER_START\n# ROLE: x\n# STATION_HEADER_END\n\ndef test():\n    pass\n", "test.py"),
        ("def test():\n    # --- CONNECTION_MAP: 1Bd --- test_func [AUTO]\n    pass\n", "test.py"),
        ("a\n# STATION_HEADER_START\nb", "x.py"),
        ("# STATION_HEADER_END\na", "x.py"),
        ("", "x.py"),
    ]
    assert told(spark, rows, drop) == ["\nconsole.log('hello');\n", "\n# Title\n", "\ndef test():\n    pass\n", "def test():\n    pass\n", "a\n", "a", ""]


def plain_strip(content, prefix, keep):
    if prefix == "<!--":
        start, end = re.compile(r"<!--\s*(?:---\s*)?STATION_HEADER_START"), re.compile(r"STATION_HEADER_END\s*(?:---\s*)?(?:\[AUTO\]\s*)?-->")
    else:
        start, end = (re.compile(rf"{re.escape(prefix)}\s*(?:---\s*)?STATION_HEADER_{x}") for x in ("START", "END"))
    out, inside = [], False
    for line in content.splitlines(keepends=True):
        gone = True
        if start.search(line):
            inside = True
        elif end.search(line):
            inside = False
        elif not inside:
            gone = line.lstrip().startswith(prefix) and "[AUTO]" in line
        if not gone:
            out.append(line)
        elif keep:
            out.append("\n")
    return "".join(out)


def test_blocks_equal_a_walk(spark):
    r = random.Random(9)
    rows = []
    for _ in range(300):
        ext, p = r.choice([(".py", "#"), (".ts", "//"), (".md", "<!--")])
        some = [f"{p} STATION_HEADER_START", f"x {p}--- STATION_HEADER_END ---", "STATION_HEADER_END --- [AUTO] -->", f"  {p} y [AUTO]", "code [AUTO]", "", "z", f"{p} STATION_HEADER_START {p} STATION_HEADER_END"]
        rows.append(("".join(r.choice(some) + r.choice(["\n", "\r\n", "\r", "\x0b", ""]) for _ in range(r.randint(0, 9))), f"f{ext}", p))
    for keep in (True, False):
        got = told(spark, [(t, p) for t, p, _ in rows], lambda t, p, keep=keep: text.strip_auto(t, p, keep))
        assert got == [plain_strip(t, prefix, keep) for t, _, prefix in rows]


def scanned(spark, rows, parsed=()):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows, 1)], "line int, path string, content string")
    return {(r.line, r.type, r.subtype) for r in extract.scan_lines(df, F.col("path"), parsed).collect()}


def test_line_routing(spark):
    bad, stub = "Incomplete/Improper", "Improper Implementation"
    rows = [
        ("a.py", "def test_func(): pass"), ("a.py", "def test_func():"), ("a.py", "    return True"), ("a.py", "# TODO x FIXME"), ("a.py", "x = 1  # TODO"), ("a.py", "    # wip: a placeholder for now"), ("a.py", "    pass"), ("a.py", "# pass"),
        ("a.py", "raise NotImplementedError"), ("a.js", "# TODO"), ("a.js", "  /// simplified"), ("a.js", "pass"), ("a.py", "# my_placeholder"), ("a.py", "# a Placeholder"), ("a.ini", "; in a real"), ("noext", "# todo"), ("a.PY", "// TODO"),
    ]
    want = {(1, stub, "One-line stub"), (4, bad, "TODO"), (4, bad, "FIXME"), (6, "Worklog", "WIP"), (7, bad, "pass"), (9, bad, "NotImplementedError"), (11, bad, "simplified"), (12, bad, "pass"), (14, bad, "placeholder"), (15, bad, "in a real"), (16, bad, "TODO")}
    assert scanned(spark, rows) == want
    assert scanned(spark, rows, (".py",)) == {x for x in want if x[0] not in (1, 7, 9)}


def plain_anchor(lines, anchor, at):
    want = anchor.strip()
    hits = [i for i, x in enumerate(lines, 1) if x.strip() == want] if want else []
    return min(hits, key=lambda i: (abs(i - at), -i), default=None)


def test_nearest_anchor_equals_a_search(spark):
    r = random.Random(2)
    texts = {d: [r.choice(["a", " a", "b", "b ", "", "c"]) for _ in range(r.randint(1, 15))] for d in range(25)}
    records = [(d, r.randint(-2, 18), r.choice(["a", "b ", " ", "c", "zz"])) for d in texts for _ in range(8)]
    lines = spark.createDataFrame([(d, i, x) for d, t in texts.items() for i, x in enumerate(t, 1)], "doc_id int, line int, content string")
    got = extract.nearest_anchors(spark.createDataFrame(records, "doc_id int, line int, anchor string"), lines).collect()
    assert sorted((x.doc_id, x.line, x.anchor, x.found or 0) for x in got) == sorted((d, at, a, plain_anchor(texts[d], a, at) or 0) for d, at, a in records)


def plain_batches(lengths, cap):
    lengths, out, start = sorted(lengths), [], 0
    while start < len(lengths):
        end = min(start + max(1, cap(lengths[start])), len(lengths))
        end = min(end, start + max(1, cap(lengths[end - 1])))
        out.append(end - start)
        start = end
    return out


@pytest.mark.parametrize("cap", [rerank_cap, lambda n: 7, lambda n: 0, lambda n: 100 // (n + 1)])
def test_cuts_equal_a_sequential_pass(cap):
    r = random.Random(6)
    for spread in (1, 3, 40, 9000):
        for _ in range(40):
            lengths = [r.randint(0, spread) for _ in range(r.randint(1, 300))]
            values = sorted(set(lengths))
            sizes: dict[int, int] = {}
            covered = []
            for _, first, last, batch, size, at in batches.cut(values, [lengths.count(v) for v in values], cap):
                for rank in range(first, last + 1):
                    covered.append(rank)
                    b = batch + (rank - first + at) // size
                    sizes[b] = sizes.get(b, 0) + 1
            assert covered == list(range(len(lengths)))
            assert [sizes[b] for b in sorted(sizes)] == plain_batches(lengths, cap)


def test_batches_of_groups(spark):
    r = random.Random(1)
    rows = [(g, i, r.randint(0, 30)) for g in ("x", "y") for i in range(120)] + [("one", 1, 5)]
    got = batches.pack_by_length(spark.createDataFrame(rows, "grp string, id int, length long"), lambda n: 40 // (n + 1)).collect()
    for g in ("x", "y", "one"):
        mine = sorted((b.length, b.id, b.batch) for b in got if b.grp == g)
        assert [b for *_, b in mine] == [i for i, n in enumerate(plain_batches([n for h, _, n in rows if h == g], lambda n: 40 // (n + 1))) for _ in range(n)]


def test_files_are_cut_into_lines_once(spark):
    """Both tellings of a file share its marked lines."""
    plan = nodes.auto_blocks(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(content") == 1
    files = spark.createDataFrame([("a.py", "x\n# [AUTO]\r\ny"), ("a.py", ""), ("a.py", None)], "path string, content string")
    assert [r[0] for r in files.select(text.strip_auto(F.col("content"), F.col("path"), True)).collect()] == ["x\n\ny", "", None]
