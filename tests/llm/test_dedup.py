"""Dedup operators against plain versions."""

import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import pytest

from tests.llm import brute
from weftline.llm import line_runs, near_dup, suffix_dups
from weftline.llm.common import spool


@pytest.mark.parametrize(("least", "long_line"), [(1, 10**9), (2, 200), (3, 60), (5, 40)])
def test_line_runs(docs, texts, least, long_line):
    got = {r.doc_id: r for r in line_runs.dedup(docs, min_lines=least, long_line=long_line).collect()}
    expected = brute.line_dedup(texts, least, long_line)
    assert {k: (r.text, r.n_runs, r.longest_run) for k, r in got.items()} == expected
    for k, r in got.items():
        lines = lambda t: sum(bool(x.strip(brute.BLANK)) for x in (t or "").split("\n"))
        assert (r.n_lines, r.n_removed) == (lines(texts[k]), lines(texts[k]) - lines(expected[k][0]))


def test_line_runs_are_maximal(spark):
    """Runs that meet are not taken for one; loops and runs that end inside each other."""
    given = {1: "a\nb", 2: "b\nc", 3: "a\nb\nc", 4: "x\n" * 9, 5: "p\nq\nr\ns\nt", 6: "p\nq\nr\nz", 7: "q\nr\ns\nt\nu\np\nq\nr\nz", 8: "long " * 50, 9: "z\n" + "long " * 50 + "\ny"}
    got = {r.doc_id: r for r in line_runs.dedup(spark.createDataFrame(list(given.items()), "doc_id long, text string")).collect()}
    assert (got[3].longest_run, got[3].n_removed, got[3].n_runs) == (2, 3, 1)
    assert (got[4].longest_run, got[4].n_removed, got[4].text) == (8, 8, "x\n")
    assert got[9].text == "z\ny" and got[8].n_removed == 0
    expected = brute.line_dedup(given, line_runs.MIN_LINES, line_runs.LONG_LINE)
    assert {k: (r.text, r.n_runs, r.longest_run) for k, r in got.items()} == expected


def test_line_runs_are_planned_by_level(spark):
    """The driver holds the plan of one level, not of all."""
    given = spark.createDataFrame([(i, "\n".join(map(str, range(9)))) for i in range(3)], "doc_id long, text string")
    found = line_runs.later_runs(given, 2, 200)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert {(r.doc, r.ord, r.size) for r in found.collect()} == {(1, 0, 9), (2, 0, 9)}


def test_line_runs_broadcast_nothing(spark, docs, monkeypatch):
    """Small and large tables are joined alike: texts meet their runs in one shuffle, whatever the size."""
    plans = []
    monkeypatch.setattr(line_runs, "spool", lambda df, label: plans.append(df._jdf.queryExecution().executedPlan().toString()) or spool(df, label))
    plans.append(line_runs.clean(docs)._jdf.queryExecution().executedPlan().toString())
    assert "SortMergeJoin" in plans[-1]
    assert not [x for x in plans if "Broadcast" in x]


def test_line_runs_edges(spark, docs, empty, texts):
    assert line_runs.dedup(empty).count() == 0
    cleaned = line_runs.clean(docs)
    assert cleaned.columns == docs.columns
    expected = brute.line_dedup(texts, line_runs.MIN_LINES, line_runs.LONG_LINE)
    assert all(r.text == expected[r.doc_id][0] for r in cleaned.collect())
    twice = line_runs.dedup(spark.createDataFrame([(1, "a\nb"), (1, "a\nb"), (None, "a\nb"), (2, "a\nb\n\nc")], "doc_id long, text string"))
    assert sorted(((r.doc_id or 0, r.text) for r in twice.collect())) in ([(0, "a\nb"), (1, ""), (1, ""), (2, "\nc")], [(0, ""), (1, "a\nb"), (1, "a\nb"), (2, "\nc")])


def test_line_runs_sql(spark, docs, texts):
    from weftline.llm.line_runs import OP9_SQL

    c = duckdb.connect()
    documents = docs.select("doc_id", "text").toPandas()
    c.register("documents", documents)
    theirs = {r[0]: r[1:] for r in c.execute(f"SELECT doc_id, n_lines, n_removed, n_runs, longest_run, kept_sha256 FROM ({OP9_SQL})").fetchall()}
    ours = {r.doc_id: (r.n_lines, r.n_removed, r.n_runs, r.longest_run, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in line_runs.dedup(docs).collect()}
    assert ours == theirs


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_components(docs, texts, width, percent):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.components(docs, width=width, percent=percent).collect()}
    assert got == brute.components(texts, width, percent)


def test_components_of_a_large_group(spark):
    """Near copies around one base whose pairs often miss the threshold; chains count."""
    r = random.Random(11)
    base = [f"w{i}" for i in range(80)]
    texts = {}
    for k in range(150):
        w = list(base)
        for _ in range(r.choice([0, 1, 2, 3, 5, 8])):
            w[r.randrange(len(w))] = f"e{r.randrange(400)}"
        texts[k] = " ".join(w)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in near_dup.components(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), width=3, percent=85).collect()}
    assert got == brute.components(texts, 3, 85)


def test_components_edges(spark, docs, empty):
    assert near_dup.components(empty).count() == 0
    assert near_dup.one_of_each(docs).columns == docs.columns
    rows = near_dup.components(spark.createDataFrame([(None, "a b c"), (4, "a b c"), (4, "a b c"), (7, None), (8, "")], "doc_id long, text string"), width=3, percent=85).collect()
    assert Counter((r.doc_id, r.component_id, r.kept) for r in rows) == Counter([(None, 4, True), (4, 4, True), (4, 4, True), (7, 7, True), (8, 8, True)])


def test_word_hashes_are_words():
    given = ["Ab  aB\tab", "", "\x0bx\x0c", "a\x00b ab", "É é"]
    h, at = near_dup.word_hashes(given)
    w = [brute.words(brute.lowered(x)) for x in given]
    assert np.diff(at).tolist() == list(map(len, w))
    flat = [x for y in w for x in y]
    assert len({(a, b) for a, b in zip(flat, h.tolist(), strict=True)}) == len(set(flat)) == len(set(h.tolist()))


@pytest.mark.parametrize(("window", "gram"), [(200, 32), (60, 20)])
def test_suffix_dedup(docs, texts, window, gram):
    got = {r.doc_id: r for r in suffix_dups.dedup(docs, window, gram).collect()}
    masks = dict(zip(texts, brute.repeated_bytes(list(texts.values()), window), strict=True))
    for k, m in masks.items():
        raw = np.frombuffer((texts[k] or "").encode(), np.uint8)
        r = got[k]
        assert bytes(r.kept) == raw[~m].tobytes(), k
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(raw), int(m.sum()), int((np.diff(m.astype(int), prepend=0) == 1).sum()))


def test_suffix_dedup_of_edited_copies(spark):
    """Copies with edits at random places: matches end inside each other's contexts."""
    r = random.Random(5)
    base = "".join(r.choice("abcdefgh ") for _ in range(700))
    texts = []
    for _ in range(40):
        t = list(base)
        for _ in range(r.randint(0, 6)):
            t[r.randrange(len(t))] = r.choice("XYZ")
        texts.append("".join(t))
    got = {x.doc_id: bytes(x.kept) for x in suffix_dups.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 60, 20).collect()}
    for k, m in enumerate(brute.repeated_bytes(texts, 60)):
        assert got[k] == np.frombuffer(texts[k].encode(), np.uint8)[~m].tobytes()


def test_minimisers_do_not_depend_on_the_chunk():
    r = random.Random(9)
    own = "".join(r.choice("abcd ") for _ in range(900))
    other = ["".join(r.choice("abcd ") for _ in range(r.randint(0, 4000))) for _ in range(40)]
    alone = suffix_dups.anchors([own], 60, 20)
    among = suffix_dups.anchors([*other, own, *other], 60, 20)
    here = among[1] == 40
    assert alone[2].tolist() == among[2][here].tolist() and alone[0].tolist() == among[0][here].tolist()


def test_cores_are_what_matching_strings_share():
    r = random.Random(3)
    for _ in range(300):
        window = r.choice([40, 60])
        x, y = ((bytes(r.choices(b"ab", k=r.randint(0, window))), bytes(r.choices(b"ab", k=r.randint(20, window)))) for _ in range(2))
        y = (x[0][: r.randint(0, len(x[0]))] + y[0], x[1][: r.randint(0, len(x[1]))] + y[1])
        a, b = (dict(suffix_dups.cores(*z, window)) for z in (x, y))
        for o in range(max(0, window - min(len(x[1]), len(y[1]))), min(len(x[0]), len(y[0])) + 1):
            first = o // suffix_dups.SPREAD * suffix_dups.SPREAD
            if x[0][:o] == y[0][:o] and x[1][: window - o] == y[1][: window - o]:
                assert a[first] == b[first]


def test_suffix_dedup_edges(spark, docs, empty):
    assert suffix_dups.dedup(empty).count() == 0
    assert suffix_dups.clean(docs).columns == docs.columns
    rows = suffix_dups.dedup(spark.createDataFrame([(1, "y" * 150 + "z" * 90), (1, "y" * 150 + "z" * 90), (None, None)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in rows) == [(0, 0), (1, 240), (1, 240)]


def test_loser_tree():
    r = random.Random(2)
    for k in (1, 2, 3, 7):
        runs = [sorted({bytes(r.choice(b"ab") for _ in range(r.randint(1, 12))) + bytes([i]) for _ in range(r.randint(0, 30))}) for i in range(k)]
        streams = [iter(list(suffix_dups.decoded(suffix_dups.front_code(x)))) if x else iter(()) for x in runs]
        got = list(suffix_dups.merged(streams))
        assert [x for x, _ in got] == sorted(y for x in runs for y in x)
        for (a, _), (b, shared) in zip(got, got[1:], strict=False):
            assert shared == suffix_dups.common(a, b)


def test_exact_stage_asks_for_no_agreements(spark, monkeypatch):
    """Only the first confirmations look at signatures, and what is linked after them is similar."""
    asked, confirm = [], near_dup.confirm
    monkeypatch.setattr(near_dup, "confirm", lambda pairs, sets, percent, least: asked.append(least) or confirm(pairs, sets, percent, least))
    r = random.Random(21)
    texts = {}
    for g in range(6):
        base = [f"g{g}w{i}" for i in range(100)]
        for _ in range(12):
            w = list(base)
            w[r.randrange(100)] = f"e{r.randrange(10**6)}"
            texts[len(texts)] = " ".join(w)
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in near_dup.components(rows, width=3, percent=85, least=30).collect()}
    assert asked == [30, 0, 0]
    whole = brute.components(texts, 3, 85)
    assert all(whole[k][1] == whole[c][1] for k, c in got.items())
