"""Dependencies by hand, and grids that move, on small cases."""

import random

from pyspark.sql import functions as F

from tests.conftest import DATA
from weftline.operators import dependency, grid, migrate

REQUEST = "request int, source string, target string, dep string, tracker string"


def made(spark, requests):
    nodes = spark.createDataFrame([("1A1", "/a"), ("1A2", "/b"), ("1A3", "/x/c"), ("1A3", "/y/c"), ("1B", "/d")], "key string, path string")
    defs = spark.createDataFrame([("t1", "/a"), ("t1", "/b"), ("t1", "/y/c"), ("t2", "/a"), ("t2", "/b"), ("t3", "/d"), ("t3", "/x/c"), ("main", "/a")], "tracker string, path string")
    told, writes = dependency.outcomes(spark.createDataFrame(requests, REQUEST), nodes, defs)
    return {(r.request, r.target): (r.status, r.trackers) for r in told.collect()}, sorted((w.request, w.tracker, w.src, w.dst, w.ch) for w in writes.collect())


def test_requests_that_are_refused(spark):
    requests = [
        (1, "1A1", "1A2", "?", None), (2, "1A1#x", "1A2", "<", None), (3, "1Z9", "1A2", "<", None), (4, "1A3", "1A2", "<", None), (5, "1A1", "1A3", "<", None), (6, "1A1", "1A1", "<", None), (7, "1A1", "1B", "<", None), (8, "1A1", "1A2", "<", "none such"),
        (9, "1A1#2", "1A2", "<", None), (10, "1A1", "1A2#", "<", None), (11, None, "1A2", "<", None),
    ]
    told, writes = made(spark, requests)
    assert {k[0]: v[0] for k, v in told.items()} == {
        1: "bad type", 2: "source bad instance", 3: "source unknown", 4: "source ambiguous", 5: "target ambiguous", 6: "self", 7: "no tracker", 8: "no tracker", 9: "source unknown", 10: "target bad instance", 11: "source unknown",
    }
    assert writes == []


def test_one_tracker_some_and_all(spark):
    told, writes = made(spark, [(1, "1A1", "1A2", "<", "t2"), (2, "1A1", "1A2#1", "d", None), (3, "1A3#2", "1A2", "x", None), (4, "1B", "1A3#1", ">", "t1"), (5, "1A1", "1A2", "n", None), (5, "1A1", "1B", "n", None)])
    assert told == {(1, "1A2"): ("ok", 1), (2, "1A2#1"): ("ok", 2), (3, "1A2"): ("ok", 1), (4, "1A3#1"): ("ok", 1), (5, "1A2"): ("ok", 2), (5, "1B"): ("ok", 0)}
    assert writes == sorted([
        (1, "t2", "/a", "/b", "<"), (1, "t2", "/b", "/a", ">"), (2, "t1", "/a", "/b", "d"), (2, "t2", "/a", "/b", "d"), (3, "t1", "/y/c", "/b", "x"), (3, "t1", "/b", "/y/c", "x"), (4, "t1", "/d", "/x/c", ">"), (4, "t1", "/x/c", "/d", "<"),
        (5, "t1", "/a", "/b", "n"), (5, "t2", "/a", "/b", "n"),
    ])


def test_requests_are_resolved_once(spark):
    """No branch of the outcomes reads the requests anew; rows of one request and target count their trackers together."""
    nodes = spark.createDataFrame([("1A1", "/a"), ("1A2", "/b")], "key string, path string")
    defs = spark.createDataFrame([("t1", "/a"), ("t1", "/b"), ("t2", "/a"), ("t2", "/a"), (None, "/a"), (None, "/b")], "tracker string, path string")
    asked = spark.range(5).select(F.expr("if(id = 4, null, cast(id / 2 as int))").alias("request"), F.lit("1A1").alias("source"), F.lit("1A2").alias("target"), F.expr("if(id = 3, '?', '<')").alias("dep"), F.expr("if(id = 0, 't2', null)").alias("tracker"))
    told, writes = dependency.outcomes(asked, nodes, defs)
    assert told._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 1
    assert {(r.request, r.status, r.trackers) for r in told.collect()} == {(0, "ok", 2), (1, "ok", 1), (1, "bad type", 1), (None, "no tracker", 0)}
    assert writes.count() == 8


def test_writes_win_and_the_last_counts(spark):
    cells = spark.createDataFrame([("t", "a", "b", "x"), ("t", "b", "a", "p")], "tracker string, src string, dst string, ch string")
    writes = spark.createDataFrame([("t", "a", "b", "s", 1), ("t", "a", "b", "p", 2), ("u", "a", "b", "<", 1)], "tracker string, src string, dst string, ch string, request int")
    assert sorted(tuple(r) for r in dependency.write(cells, writes).collect()) == [("t", "a", "b", "p"), ("t", "b", "a", "p"), ("u", "a", "b", "<")]


def test_checklist_has_pairs_of_code_and_document(spark):
    nodes = spark.createDataFrame([("1", "/doc/a"), ("2", "/src/b"), ("3", "/src/c")], "key string, path string")
    requests = spark.createDataFrame([(1, "1", "2", "d", None), (2, "2", "3", "<", None), (3, "3", "1", "<", None), (4, "1", "1", "d", None), (5, "2", "1", "?", None)], REQUEST)
    assert sorted((r.request, r.src, r.dst, r.dep) for r in dependency.checklist(requests, nodes, F.col("path").startswith("/doc/")).collect()) == [(1, "/doc/a", "/src/b", "d"), (3, "/src/c", "/doc/a", "<")]


def plain_migration(cells, rows, defs, moves, current, new_defs):
    paths = {}
    for key, p in current:
        paths.setdefault(key, []).append(p)
    went = {p: (p if p in paths.get(k, ()) else min(paths[k])) for p, k in moves if k in paths}
    out = dict(cells)
    for tracker in sorted(defs):
        for i, row in enumerate(rows[tracker]):
            if len(row) != len(defs[tracker]):
                continue
            for j, ch in enumerate(row):
                a, b = went.get(defs[tracker][i]), went.get(defs[tracker][j])
                if ch in "op." or a is None or b is None or a == b or a not in new_defs[tracker] or b not in new_defs[tracker]:
                    continue
                if out.get((tracker, a, b)) == "p":
                    out[tracker, a, b] = ch
    return out


def test_migration_equals_a_walk(spark):
    r = random.Random(8)
    old = [f"/o{i}" for i in range(12)]
    moves = [(p, r.choice([f"K{i}", f"K{r.randint(0, 11)}", None])) for i, p in enumerate(old)]
    current = [(f"K{i}", p) for i in range(12) for p in r.sample([f"/o{i}", f"/n{i}", f"/m{i}"], r.randint(0, 2))]
    everywhere = sorted({p for _, p in current})
    defs = {t: r.sample(old, 8) for t in ("t", "u")}
    rows = {t: ["".join("o" if i == j else r.choice("<>xdpn.") for j in range(8)) + ("p" if r.random() < 0.15 else "") for i in range(8)] for t in defs}
    new_defs = {t: set(r.sample(everywhere, len(everywhere) * 3 // 4)) for t in defs}
    cells = {(t, a, b): r.choice("ppps") for t in defs for a in new_defs[t] for b in new_defs[t] if a != b}
    make = lambda data, schema: spark.createDataFrame(data, schema)
    old_rows = make([(t, i, x) for t in defs for i, x in enumerate(rows[t])], "tracker string, ord int, row string")
    old_defs = make([(t, i, p) for t in defs for i, p in enumerate(defs[t])], "tracker string, ord int, path string")
    got = migrate.migrate(make([(*k, v) for k, v in cells.items()], "tracker string, src string, dst string, ch string"), old_rows, old_defs, make(moves, "path string, new_key string"), make(current, "key string, path string"), make([(t, p) for t in defs for p in new_defs[t]], "tracker string, path string"))
    assert {(x.tracker, x.src, x.dst): x.ch for x in got.collect()} == plain_migration(cells, rows, defs, moves, current, new_defs)
    assert {(x.tracker, x.ord) for x in migrate.damaged(old_rows, old_defs).collect()} == {(t, i) for t in defs for i, x in enumerate(rows[t]) if len(x) != 8}


def test_home_trackers_and_pruning(spark):
    keys = spark.createDataFrame([(t, p) for t in ("h1", "h2", "in") for p in ("/a", "/b", "/d/c")], "tracker string, key string")
    cells = spark.createDataFrame([("h1", "/a", "/b", "d"), ("h2", "/a", "/b", "<"), ("h1", "/b", "/a", "n"), ("h2", "/b", "/a", "<"), ("in", "/a", "/d/c", "x")], "tracker string, src string, dst string, ch string")
    rows = grid.pivot(cells, keys).join(spark.createDataFrame([("/a", 0), ("/b", 1), ("/d/c", 2)], "key string, ord int"), "key").select("tracker", "ord", "row")
    defs = keys.join(spark.createDataFrame([("/a", 0), ("/b", 1), ("/d/c", 2)], "key string, ord int"), "key").select("tracker", "ord", F.col("key").alias("path"))
    make = lambda data, schema: spark.createDataFrame(data, schema)
    members, homes = make([("in", "/a"), ("in", "/b"), ("in", "/d/c")], "tracker string, path string"), make([("/a", "h1"), ("/b", "h2"), ("/d/c", "in")], "path string, home string")
    told = migrate.external(members, homes, rows, defs, make([("in",)], "tracker string")).collect()
    assert {(r.src, r.dst): (r.ch, r.origins) for r in told} == {("/a", "/b"): ("<", ["h2"]), ("/b", "/a"): ("n", ["h1", "h2"])}
    kept, below = migrate.pruned(cells, defs, make([("/d",), ("/a",)], "root string"))
    assert sorted((r.tracker, r.src, r.dst) for r in kept.collect()) == [("in", "/a", "/d/c")] and {r.path for r in below.collect()} == {"/a", "/d/c"}


def test_wide_rows_are_stepped_over(spark):
    """Runs of two thousand million placeholders are neither written out nor split."""
    row = "p2000000000<3p40x"
    rows = spark.createDataFrame([("t", 0, row)], "tracker string, ord int, row string")
    assert [(x.tracker, x.row_ord, x.col, x.ch) for x in migrate.said(rows).collect()] == [("t", 0, 2000000000 + i, "<") for i in range(3)] + [("t", 0, 2000000043, "x")]


def test_damage_is_told_without_writing_rows_out(spark):
    rows = spark.createDataFrame([("t", 0, "op"), ("t", 1, "p2000000000o"), ("t", 2, "po"), ("u", 0, "o")], "tracker string, ord int, row string")
    defs = spark.createDataFrame([("t", 0, "/a"), ("t", 1, "/b")], "tracker string, ord int, path string")
    assert {tuple(x) for x in migrate.damaged(rows, defs).collect()} == {("t", 1, "wrong length"), ("t", 2, "no definition"), ("u", 0, "no definition")}


def test_new_grids_write_no_placeholders(spark):
    """Only what the new grid says is written out: no list of a tracker's paths, no pair that says nothing."""
    from weftline.plans import moves

    cells = moves.sure_cells(spark, DATA)
    now = [tuple(x) for x in moves.current(spark, DATA).select("tracker", "path", "c").collect()]
    assert sorted(tuple(x) for x in cells.collect()) == sorted((t, p, q) for t, p, c in now for u, q, d in now if t == u and p != q and (c + d) % 5 == 0)
    assert "collect_list" not in cells._jdf.queryExecution().optimizedPlan().toString()
