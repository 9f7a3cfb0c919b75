"""Operators 11 to 13 against plain versions."""

import random
from collections import Counter, defaultdict
from itertools import combinations

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests import oracle
from tests.conftest import DATA
from tests.llm import brute
from weftline.llm import divergence, simhash, whitening


def plain_fingerprint(text, width=3):
    w = [x.decode() for x in brute.words(brute.lowered(text))]
    grams = [" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints):
    """print -> smallest print it is linked with, over links of up to three bits."""
    up = {p: p for p in prints}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(sorted(prints), 2):
        if bin(a ^ b).count("1") <= 3:
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return {p: root(p) for p in prints}


def test_golay_code_is_perfect():
    single, errors = simhash.decoder()
    assert len(np.unique(errors)) == 2048
    words = np.arange(0, 1 << 22, 101)
    centre, near = simhash.centres(words, 22)
    assert centre.min() >= 0 and set(np.unique((near >= 0).sum(1))) <= {1, 2, 3, 4, 5, 6}
    for bit in range(22):  # one bit apart: each other's centre is near
        other, theirs = simhash.centres(words ^ (1 << bit), 22)
        assert (near == other[:, None]).any(1).all() and (theirs == centre[:, None]).any(1).all()


def test_every_pair_of_three_bits_shares_a_key():
    r = random.Random(1)
    a = np.array([r.getrandbits(64) for _ in range(600)], np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for at in r.sample(range(64), i % 4):
            b[i] ^= np.uint64(1 << at)
    for x, y in ((a, b), (b, a)):
        row, key, probe = simhash.golay_keys(x.view(np.int64))
        posts = set(zip(row[~probe].tolist(), key[~probe].tolist(), strict=True))
        row, key, probe = simhash.golay_keys(y.view(np.int64))
        met = {i for i, k in zip(row[probe].tolist(), key[probe].tolist(), strict=True) if (i, k) in posts}
        assert met == set(range(len(a)))


def test_fingerprints(texts):
    for t in [*texts.values(), "One", "ONE two", "a b c", "a  b\tc\x0bd\x1ce", " x y z"]:
        assert simhash.fingerprint(t or "") == plain_fingerprint(t)


def clusters(r):
    prints = [0, (1 << 64) - 1]
    for _ in range(12):
        p = r.getrandbits(64)
        for _ in range(r.randint(1, 14)):
            prints.append(p)
            for at in r.sample(range(64), r.randint(1, 5)):
                p ^= 1 << at
    base = r.getrandbits(64)  # a dense ball, in which keys are crowded
    prints += [base ^ sum(1 << at for at in r.sample(range(64), r.randint(0, 3))) for _ in range(150)]
    return sorted(set(prints))


@pytest.mark.parametrize("crowd", [2, 20, simhash.CROWD])
def test_links_make_the_components_of_all_pairs(spark, crowd):
    prints = clusters(random.Random(crowd))
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    df = spark.createDataFrame([(signed(p),) for p in prints], "fp long").repartition(3)
    found = [(r.u & (2**64 - 1), r.v & (2**64 - 1)) for r in simhash.links(df, crowd).collect()]
    assert all(0 < bin(a ^ b).count("1") <= 3 for a, b in found)
    up = {p: p for p in prints}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in found:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    assert {p: root(p) for p in prints} == plain_components(prints)


def test_simhash_broadcasts_no_keys(spark):
    """The keys are 65 times the fingerprints that their size is estimated by."""
    prints = spark.range(50).select(F.xxhash64("id").alias("fp"))
    plan = simhash.links(prints)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("crowd", [3, simhash.CROWD])
def test_simhash_components(spark, docs, texts, crowd):
    rows = {r.doc_id: r for r in simhash.components(docs, crowd=crowd).collect()}
    prints = {k: plain_fingerprint(v) for k, v in texts.items()}
    comp = plain_components(set(prints.values()))
    least = {}
    for k, p in prints.items():
        least[comp[p]] = min(k, least.get(comp[p], k))
    assert {k: (r.fingerprint, r.component_id) for k, r in rows.items()} == {k: (f"{p:016x}", least[comp[p]]) for k, p in prints.items()}
    kept = {r.doc_id for r in simhash.one_of_each(docs).collect()}
    assert kept == set(least.values())


def test_simhash_edges(spark, empty):
    assert simhash.components(empty).count() == 0
    rows = [(1, "a b c d"), (1, "a b c d"), (1, "other words here now"), (None, "a b c d"), (None, "alone here"), (7, None), (9, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.fingerprint, r.component_id or -1) for r in simhash.components(df).collect())
    f = lambda t: f"{plain_fingerprint(t):016x}"
    assert got == sorted([(1, f("a b c d"), 1), (1, f("a b c d"), 1), (1, f("other words here now"), 1), (-1, f("a b c d"), 1), (-1, f("alone here"), -1), (7, "0" * 16, 7), (9, "0" * 16, 7)])


def plain_whitening(vectors):
    x = np.array([np.floor(np.float64(v) * 64).astype(np.int64) + 1_000_000 for v in vectors])
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    c = (fit * n - s) / n
    e, v = np.linalg.eigh(c.T @ c / n)
    order = np.argsort(-e)
    return x, n, s, e[order], v[:, order]


def test_whitening_against_eigenvectors(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").repartition(11)
    got = whitening.op12_whitening(spark, DATA).toPandas().sort_values(["component", "vec_id"])
    data = {r.vec_id: r.embedding for r in rows.collect()}
    ids = sorted(data)
    x, n, s, e, v = plain_whitening([data[i] for i in ids])
    assert set(got.n) == {n} and got.identity_error.max() <= 1e-10 and len(got) == 16 * len(ids)
    for k in range(1, 17):
        mine = got[got.component == k]
        assert mine.vec_id.tolist() == ids
        assert mine.deviation.tolist() == [sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, s, strict=True)) for r in x]
        expected = (x * n - s) / n @ v[:, k - 1] / np.sqrt(e[k - 1])
        sign = np.sign(expected @ mine.whitened.to_numpy())
        assert np.allclose(mine.whitened, sign * expected, atol=1e-8)
        assert np.allclose(mine.explained, e[k - 1] / e.sum(), rtol=1e-9)


def test_whitening_edges(spark):
    r = np.random.default_rng(3)
    wide, narrow = r.normal(size=(40, 5)), r.normal(size=(9, 3)) * [1, 2, 0]
    rows = [(i, [float(c) for c in v], "x") for i, v in enumerate(wide)]
    rows += [(100 + i, [float(c) for c in v], None) for i, v in enumerate(narrow)]
    rows += [(200, rows[0][1], "again"), (None, rows[1][1], "no id"), (300, None, ""), (301, [1.0, None, 2.0, 3.0, 4.0], ""), (302, [float("nan")] * 5, ""), (303, [float("inf")] * 5, ""), (304, [], ""), (305, [1e30] * 5, ""), (306, [1.0] * 7, "alone")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, x string").repartition(13)
    got = whitening.whiten(df).toPandas()
    assert set(got.vec_id.dropna().astype(int)) == {*range(40), *range(100, 109), 200}
    assert (got.groupby("vec_id").size().loc[[0, 200]] == 5).all() and got.vec_id.isna().sum() == 5
    assert (got[got.vec_id.between(100, 108)].groupby("vec_id").size() == 2).all()  # the third direction has no variance
    assert set(got[got.vec_id < 100].n) == {40} and set(got[got.vec_id.between(100, 108)].n) == {9}
    assert got.identity_error.max() < 1e-9
    a, b = (got[got.vec_id == i].sort_values("component") for i in (0, 200))
    assert a.whitened.tolist() == b.whitened.tolist() and a.deviation.tolist() == b.deviation.tolist()
    assert whitening.whiten(df.where("x = 'none'")).count() == 0


def test_deviations_are_exact_or_null():
    w = whitening.Whitener(10**6, np.array([5, -7], object), np.eye(2), np.ones(2), 2.0)
    x = np.array([[3, 4], [1 << 40, 0], [2000, -1]])
    exact = [sum((w.n * int(c) - s) ** 2 for c, s in zip(row, (5, -7), strict=True)) for row in x]
    assert whitening.deviations(x, w) == [v if v < 1 << 63 else None for v in exact]
    assert whitening.deviations(x[:1], w) == exact[:1]


def test_divergence_against_sql(spark, docs):
    table = docs.select("doc_id", "text", "lang", F.when(F.col("doc_id") % 11 == 5, None).otherwise(F.col("source")).alias("source"), F.lit(1).alias("term"), F.lit("x").alias("part"))
    one = table.limit(1).select("doc_id", F.lit("a bb ccc").alias("text"), F.lit("zz").alias("lang"), "source", "term", "part")
    table = table.unionByName(one).unionByName(one.withColumn("source", F.lit("é"))).cache()
    duck = duckdb.connect()
    documents = table.select("doc_id", "text", "lang", "source").toPandas()  # noqa: F841
    theirs = oracle.rows(duck.execute(divergence.OP13_SQL).df())
    assert theirs
    for chunk in (2, 7, divergence.CHUNK):
        assert oracle.rows(divergence.audit(table, chunk=chunk).toPandas()) == theirs


def test_divergence_ties_and_bounds(spark, empty):
    assert divergence.audit(empty).count() == 0
    words = [f"t{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)] + ["ä", "z\U0001f600", "￿"]
    text = " ".join(words)
    rows = [(i, text if i % 2 else "other Words", "en", "ab"[i % 2]) for i in range(8)]
    got = divergence.audit(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), chunk=16).collect()
    terms = sorted([r for r in got if r.part == "term" and r.source == "b"], key=lambda r: r.rank)
    assert [r.item for r in terms] == sorted(words, key=lambda w: w.encode())[:200] and [r.rank for r in terms] == list(range(1, 201))
    big = np.array([0, 10**15, 9 * 10**14])
    assert divergence.shares(big, 9 * 10**15).tolist() == [1 + 10**9 * (int(c) + 1) // (9 * 10**15) for c in big]


def test_terms_are_runs_of_letters_and_other_scripts(texts):
    import re

    some = [x or "" for x in texts.values()] + ["Don't_stop", "ÄBCé x1y", "\x7fa\x80b"]
    terms, at = divergence.terms_of(some)
    expected = defaultdict(list)
    for i, t in enumerate(some):
        expected[i] = [w.encode() for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", brute.lowered(t))]
    got = defaultdict(list)
    for w, i in zip(terms.to_pylist(), at.tolist(), strict=True):
        got[i].append(w)
    assert {k: v for k, v in expected.items() if v} == got
    distinct, ids = divergence.encoded(terms)
    assert distinct.to_pylist() == sorted(Counter(terms.to_pylist())) and [distinct[i].as_py() for i in ids.tolist()] == terms.to_pylist()
