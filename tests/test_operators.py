"""Literal cases of operators, and properties of the codec."""

import random

import pytest
from pyspark.sql import functions as F

from weftline.functions import chars, codec, keys, text
from weftline.operators import extract, merge, symbols, tree
from weftline.sources import files, logs, sinks, trackers


def column(spark, values, f, kind="string"):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").orderBy("i").select(f(F.col("v"))).collect()]


def test_codec_literals(spark):
    assert column(spark, ["nnnnnpppdd", "ppp", "oppppx", "pppooooS", "", None], codec.encode) == ["n5p3dd", "ppp", "op4x", "p3ooooS", "", None]


def test_codec_round_trip(spark):
    r = random.Random(1)
    texts = ["".join(r.choice("<>xdsSnpo.") * r.randint(1, 15) for _ in range(r.randint(0, 12))) for _ in range(200)]
    assert column(spark, texts, lambda v: codec.decode(codec.encode(v))) == texts


def test_char_at(spark):
    assert column(spark, ["n5p3dd"] * 3, lambda v: codec.char_at(v, F.lit(6))) == ["p"] * 3
    assert column(spark, ["n5"], lambda v: codec.char_at(v, F.lit(5))) == [None]
    assert column(spark, ["n5p3dd"], lambda v: codec.set_char(v, F.lit(0), F.lit("x"))) == ["xn4p3dd"]


def test_keys(spark):
    given = ["1A", "2A5#1", "1Bg3", "3X1#1", "A1", "1A0", "1Aa01", "1A#0"]
    assert column(spark, given, keys.valid) == [True] * 4 + [False] * 4
    ordered = sorted(["2A10", "2A1", "2A2", "1B", "10A"], key=dict(zip(["2A10", "2A1", "2A2", "1B", "10A"], column(spark, ["2A10", "2A1", "2A2", "1B", "10A"], keys.natural), strict=True)).get)
    assert ordered == ["1B", "2A1", "2A2", "2A10", "10A"]


def test_paths(spark):
    assert column(spark, ["/a//b/./c/../d/", "a\\b", "/..", "/a\u200bb"], text.normal_path) == ["/a/b/d", "a/b", "/", "/ab"]
    same = ["a = 1  \r\n\r\n#x", "  a = 1\n# x\n"]
    assert len(set(column(spark, same, text.content_hash))) == 1


def test_priorities(spark):
    assert column(spark, list("x<>ndSspo. -") + [None], chars.priority) == [6, 5, 5, 5, 4, 3, 2, 1, 1, 0, 0, 0, 0]


def test_too_many_directories(spark):
    rows = [(f"/{i:03d}", None, True) for i in range(27)]
    with pytest.raises(Exception, match="26"):
        tree.assign_keys(spark.createDataFrame(rows, "path string, parent_path string, is_dir boolean"), 1).collect()


def test_promotion(spark):
    rows = [("/r", None, True), ("/r/d", "/r", True), ("/r/d/e", "/r/d", True), ("/r/d/e/f", "/r/d/e", False), ("/r/x", "/r", False)]
    got = {r.path: (r.key, r.tier) for r in tree.assign_keys(spark.createDataFrame(rows, "path string, parent_path string, is_dir boolean"), 4).collect()}
    assert got == {"/r": ("1A", 1), "/r/d": ("1Aa", 1), "/r/d/e": ("2A", 2), "/r/d/e/f": ("2A1", 2), "/r/x": ("1A1", 1)}


EDGE = "tracker string, src string, dst string, ch string"


def edges(spark, rows):
    return spark.createDataFrame(rows, EDGE)


def test_reciprocal_expansion(spark):
    given = edges(spark, [("t", "A", "B", ">"), ("t", "A", "C", "x"), ("t", "A", "D", "n"), ("t", "E", "F", "<")])
    added = merge.with_reciprocals(given).exceptAll(given)
    assert sorted((r.src, r.dst, r.ch) for r in added.collect()) == [("B", "A", "<"), ("C", "A", "x"), ("F", "E", ">")]


def test_reciprocals_do_not_promote_in_a_batch(spark):
    given = edges(spark, [("t", "1", "2", ">"), ("t", "2", "1", "n")])
    assert sorted(r.ch for r in merge.apply_reciprocals(given, force=True).collect()) == ["<", ">"]
    assert sorted(r.ch for r in merge.apply_reciprocals(given).collect()) == [">", "n"]


def test_direct_write_promotes(spark):
    now = edges(spark, [("t", "1A", "1B", "p"), ("t", "1B", "1A", "<")])
    got = merge.apply_suggestions(now, edges(spark, [("t", "1A", "1B", ">")])).collect()
    assert {(r.src, r.dst): r.ch for r in got} == {("1A", "1B"): "x", ("1B", "1A"): "x"}


def test_across_trackers_ties(spark):
    got = merge.across_trackers(edges(spark, [("a", "1", "2", "<"), ("b", "1", "2", "n"), ("c", "1", "2", ">"), ("a", "1", "3", "<"), ("b", "1", "3", ">"), ("c", "1", "3", ">")])).collect()
    assert {r.dst: (r.ch, r.origins) for r in got} == {"2": ("n", ["b"]), "3": (">", ["b", "c"])}


def test_combination(spark):
    rows = [("p", "q", "<", 1), ("p", "q", ">", 2), ("p", "r", "n", 1), ("p", "r", "<", 2), ("p", "s", "d", 1), ("p", "s", "x", 2)]
    got = merge.combine_suggestions(spark.createDataFrame(rows, "src string, dst string, ch string, seq int"), ["src", "dst"]).collect()
    assert {r.dst: r.ch for r in got} == {"q": "x", "r": "n", "s": "x"}


def test_roll_up_keeps_inside(spark):
    closure = spark.createDataFrame([("/a", "/a/1"), ("/a", "/a/2"), ("/b", "/b/1")], "ancestor string, node string")
    got = merge.roll_up(spark.createDataFrame([("/a/1", "/a/2", "<"), ("/a/1", "/b/1", "<"), ("/a/2", "/b/1", ">")], "src string, dst string, ch string"), closure).collect()
    assert {(r.src, r.dst): r.ch for r in got} == {("/a/1", "/a/2"): "<", ("/a/1", "/b/1"): "<", ("/a/2", "/b/1"): ">", ("/a", "/b/1"): "x"}


def test_trackers_round_trip(spark, tmp_path):
    d = spark.createDataFrame([("t", 0, "1A", "/a"), ("t", 1, "1B", "/b"), ("t", 2, "1C", "/c")], "tracker string, ord int, key string, path string")
    rows = spark.createDataFrame([("t", "1A", "o<d"), ("t", "1B", ">op"), ("t", "1C", "ppo")], "tracker string, key string, row string")
    sinks.tracker_text(d, rows, "now").select("content").coalesce(1).write.option("lineSep", "\n").text(str(tmp_path / "x"))
    docs = trackers.read(spark, str(tmp_path / "x"), "*.txt")
    assert {(r.key, r.path) for r in trackers.definitions(docs).collect()} == {("1A", "/a"), ("1B", "/b"), ("1C", "/c")}
    assert {(r.src, r.dst, r.ch) for r in trackers.cells(docs).collect()} == {("1A", "1B", "<"), ("1A", "1C", "d"), ("1B", "1A", ">"), ("1B", "1C", "p"), ("1C", "1A", "p"), ("1C", "1B", "p")}
    assert {r.kind for r in trackers.stamps(docs).collect()} == {"key", "grid"}


def test_batch_commit(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    for i in range(4):
        sinks.commit_all(spark, {a: spark.range(i + 1)})
    assert spark.read.parquet(a).count() == 4
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a", "a.backup-2", "a.backup-3"]
    broken = spark.range(1).select(F.raise_error(F.lit("no")).alias("x"))
    with pytest.raises(Exception, match="no"):
        sinks.commit_all(spark, {a: spark.range(9), b: broken})
    assert spark.read.parquet(a).count() == 4
    assert not (tmp_path / "b").exists()


def test_cycle_sinks(spark, tmp_path):
    path = str(tmp_path / "c")
    sinks.save_cycle(spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "cycle int, v string"), path)
    sinks.save_cycle(spark.createDataFrame([(3, "d")], "cycle int, v string"), path)
    kept = sinks.retained(spark.read.parquet(path), 2)
    assert sorted((r.cycle, r.v) for r in kept.collect()) == [(2, "b"), (3, "d")]


def test_pairs_of_cycles(spark):
    p = "array<struct<source:string,target:string>>"
    rows = [(1, [("a", "b")], [], []), (2, [], [("c", "d")], [("e", None)]), (3, [("a", "b")], [], [])]
    got = logs.cycle_pairs(spark.createDataFrame(rows, f"cycle int, all_pairs {p}, top {p}, bottom {p}"), 2).collect()
    assert sorted((r.source, r.target) for r in got) == [("a", "b"), ("c", "d")]


def test_json_comments(spark):
    given = ['{"a": "x // y", /* c */ "b": 1, // d\n}']
    assert column(spark, given, lambda v: F.get_json_object(files.strip_json_comments(v), "$.a")) == ["x // y"]


def test_broken_source_is_one_row():
    assert symbols.read_symbols("p", "def (") == [("p", "error", "SyntaxError", None, 0, 0, None)]
    assert symbols.read_symbols("p", None) == []
    stubs = [r for r in symbols.read_symbols("p", "class A:\n def f(self):\n  'doc'\n  ...\n def g(self):\n  return 1\n") if r[6] == "stub"]
    assert [r[2] for r in stubs] == ["f"]


def test_points_by_subtype(spark):
    from weftline.operators import issues

    rows = [("Annotated Stub", 1, True), ("Exported Placeholder", 0, True), ("Empty/Stub Function", 0, False), ("NotImplementedError", 3, False), ("Async Stub", 9, True), ("TODO", 0, False), (None, 0, False)]
    df = spark.createDataFrame(rows, "subtype string, callers int, exported boolean")
    p = issues.points(F.col("subtype"), F.col("callers"), F.col("exported"))
    got = {r.subtype: (r.p, r.s) for r in df.select("subtype", F.coalesce(p, F.lit(0)).alias("p"), issues.severity(F.coalesce(p, F.lit(0))).alias("s")).collect()}
    assert got == {"Annotated Stub": (4, "critical"), "Exported Placeholder": (3, "high"), "Empty/Stub Function": (1, "medium"), "NotImplementedError": (3, "high"), "Async Stub": (3, "high"), "TODO": (0, "low"), None: (0, "low")}


def test_comment_tags_have_two_tiers(spark):
    from weftline.operators import extract

    said = ["# refactor this wip", "x = 1  # noqa", "# type: ignore", "# Note: see above", "# note without colon", "# stub", "# FIXME before todo", "# BUG"]
    got = {r.line: (r.subtype, r.tier) for r in extract.comments(spark.createDataFrame([("a", i, x) for i, x in enumerate(said)], "path string, line int, content string"), "#", "path").collect()}
    assert got == {0: ("WIP", "incomplete"), 1: ("NOQA", "audit"), 2: ("TYPE:", "audit"), 3: ("NOTE:", "audit"), 4: (None, None), 5: ("STUB", "incomplete"), 6: ("TODO", "incomplete"), 7: (None, None)}


def test_deeper_trees_fail(spark):
    from weftline.operators import tree

    chain = spark.createDataFrame([("a", None, True), ("a/b", "a", True), ("a/b/c", "a/b", True), ("a/b/c/d", "a/b/c", False)], "path string, parent_path string, is_dir boolean")
    assert tree.closure(chain, 4).count() == 6
    assert tree.assign_keys(chain, 4).count() == 4
    for short in (tree.closure(chain, 3).select("ancestor"), tree.assign_keys(chain, 3).select("path")):
        with pytest.raises(Exception, match="more than 3 levels"):
            short.collect()


def test_bad_bytes_are_replaced(spark, tmp_path):
    from weftline.sources import files

    (tmp_path / "a.py").write_bytes(b"x = '\xff'\n")
    (tmp_path / "b.py").write_bytes("é\n".encode())
    assert {r.path.rpartition("/")[2]: r.content for r in files.read_text(spark, str(tmp_path)).collect()} == {"a.py": "x = '\ufffd'\n", "b.py": "é\n"}


def test_a_failed_move_undoes_those_before_it(spark, tmp_path, monkeypatch):
    from weftline.sources import sinks

    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    sinks.commit_all(spark, {one: spark.range(1), two: spark.range(2)})
    move = sinks._move

    def failing(spark, source, target, moved):
        if target == two and "staged" in source:
            raise OSError("no")
        move(spark, source, target, moved)

    monkeypatch.setattr(sinks, "_move", failing)
    with pytest.raises(OSError, match="no"):
        sinks.commit_all(spark, {one: spark.range(5), two: spark.range(6)})
    assert (spark.read.parquet(one).count(), spark.read.parquet(two).count()) == (1, 2)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["one", "two"]


def test_references_in_either_quotes(spark):
    from weftline.operators import extract

    page = """<A HREF='a.html'>x</A><a href="b.html">y</a><img src='c.png'>"""
    urls = {r.url for r in extract.html_references(spark.createDataFrame([(1, page)], "page_id long, html string")).collect()}
    assert {"a.html", "b.html"} <= urls
