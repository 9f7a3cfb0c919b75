"""Near-duplicate documents by a join on signature coordinates (operator 6).

Every distinct set of word shingles gets a MinHash signature. A set is posted
under each of its (coordinate, value) pairs. Two sets that agree on ``least``
of ``coordinates`` pairs must share one of the first ``coordinates - least + 1``
pairs of each in any common order; rarest first, that prefix holds the pairs
hardly anyone else has, and a set with too few shared pairs is skipped at once.

Groups of copies are never expanded into their pairs. In each posting list the
set that shares most of its pairs is the hub, and only (hub, member) pairs are
compared: collisions of the two signatures are counted, and pairs at or above
the match threshold are confirmed on the full sets. Linked sets form
components. The sets of lists that still span several components are then settled
exactly, by a second inverted join on their shingles, whose prefix filter loses
nothing: hubs first, then pairs across components, each only where the counts of
shingles that the two sets have in common with anyone allow the similarity.

Defined results: a null, empty or blank text has an empty set and is linked with
nothing; a text of fewer words than a shingle is one shingle; equal sets are
always linked; equal rows each get a row; an empty table gives no rows; texts of
any length are read whole; other columns are ignored by ``components``.
The second join asks for no agreements of signatures. Two sets exactly at the
similarity threshold that do not meet there, and that no path joins, are lost
with the probability of fewer than ``least`` agreements: 1.9e-5 at 85 per cent
(18 of 32), 6.6e-6 at 80 (15 of 32); farther above it, far less.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import as_bytes, id_text, mixed, shuffled, spool, table, text_batches

COORDINATES, LEAST = 32, 18
#: Members compared with one copy of their hub's set by one task.
HUB_MEMBERS = 512
PRIME = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(1)
def _byte_values() -> np.ndarray:
    return mixed(np.arange(1, 257, dtype=np.uint64) * PRIME)


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """PRIME ** i and its inverses modulo 2 ** 64 for i < n."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((int(PRIME), pow(int(PRIME), -1, 1 << 64))):
            x = np.full(n + n // 4, base, np.uint64)
            x[0] = 1
            _POWERS[k] = np.multiply.accumulate(x)
    return _POWERS[0][:n], _POWERS[1][:n]


@lru_cache(1)
def _is_blank() -> np.ndarray:
    out = np.zeros(256, bool)
    out[[9, 10, 11, 12, 13, 32]] = True
    return out


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every lower-cased (A-Z) word, and the count of words before each text (one more at the end)."""
    data, starts = as_bytes(texts)
    upper = (data >= 65) & (data <= 90)
    data = np.where(upper, data + np.uint8(32), data)
    blank = _is_blank()[data]
    blank[starts[1:] - 1] = True
    first = np.flatnonzero(~blank & np.append(True, blank[:-1]))
    end = np.flatnonzero(blank & np.append(False, ~blank[:-1]))
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_byte_values()[data] * up[:-1], out=total[1:])
    h = mixed((total[end] - total[first]) * down[first] + (end - first).astype(np.uint64) * PRIME)
    return h, np.searchsorted(first, starts)


def shingle_sets(texts: list[str], width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    h, at = word_hashes(texts)
    acc = np.zeros(max(len(h) - width + 1, 0), np.uint64)
    for i in range(width):
        acc = mixed(acc * PRIME + h[i : len(h) - width + 1 + i]) if len(acc) else acc
    out = []
    for a, b in zip(at.tolist(), at[1:].tolist(), strict=False):
        if b - a >= width:
            out.append(np.unique(acc[a : b - width + 1]))
        elif b > a:
            one = np.zeros(1, np.uint64)
            for x in h[a:b]:
                one = mixed(one * PRIME + x)
            out.append(mixed(one + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


@lru_cache(4)
def _multipliers(n: int) -> list[np.uint64]:
    return list(mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1))


def signatures(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """(non-empty sets, coordinates): the least value of each coordinate's permutation; values of different coordinates do not meet."""
    full = [x for x in sets if len(x)]
    if not full:
        return np.zeros((0, coordinates), np.int64)
    flat = np.concatenate(full)
    starts = np.cumsum([0, *map(len, full[:-1])])
    return np.stack([np.minimum.reduceat(flat * m, starts) for m in _multipliers(coordinates)], 1).view(np.int64)


def signed(docs: DataFrame, width: int, coordinates: int) -> DataFrame:
    """doc_id, n, k1, k2 (128-bit digest of the set), sig array<long> (null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in text_batches(batches):
            sets = shingle_sets([x or "" for x in texts], width)
            rows = iter(signatures(sets, coordinates))
            sig = [next(rows) if len(s) else None for s in sets]
            digest = np.frombuffer(b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.array(sig, pa.list_(pa.int64()))], ["doc_id", "n", "k1", "k2", "sig"])

    return docs.mapInArrow(run, "doc_id long, n long, k1 long, k2 long, sig array<long>")


def rarest_first(posts: DataFrame, prefix: str) -> DataFrame:
    """posts (doc, n, key, size) -> (key, doc, n, shared, rest): the prefix of each document's keys by rarity.

    A key that only one document has cannot lead to another; such keys fill the
    front of the prefix without being kept. ``prefix`` gives its length from
    ``n`` (of the set) and ``size`` (of the keys); ``rest`` counts the keys that follow one.
    """
    counts = spool(posts.groupBy("key").agg(F.count(F.lit(1)).alias("f")).where("f > 1").select(F.col("key").alias("key_"), "f"), "counts")
    per_doc = posts.join(shuffled(counts), posts["key"] == counts["key_"]).groupBy("doc", "n", "size").agg(F.sort_array(F.collect_list(F.struct("f", "key"))).alias("keys"))
    kept = per_doc.withColumn("shared", F.size("keys")).withColumn("keep", F.expr(f"({prefix}) - (size - shared)")).where("keep > 0")
    placed = kept.select("doc", "n", "shared", F.posexplode(F.expr("slice(keys, 1, keep)")).alias("at", "p"))
    return placed.select("p.key", "doc", "n", "shared", (F.col("shared") - F.col("at") - 1).alias("rest"))


def possible(percent: int, exact: bool) -> str:
    """Whether sizes allow the similarity of a row and its hub.

    With ``exact`` posts, two bounds. ``shared`` counts the shingles that a set has in common with any other: two
    sets have no more in common than the lesser count, and all else of both is in their union. And at the first key
    that two sets have in common, they have no more in common than that key and the lesser number of keys after it;
    so a pair that is similar enough passes at its first common key, whatever it does at later ones.
    """
    if exact:
        most = "least(shared, hub_shared, 1 + least(rest, hub_rest))"
        return f"100 * {most} >= {percent} * (n + hub_n - {most})"
    return f"100 * least(n, hub_n) >= {percent} * greatest(n, hub_n)"


def hub_pairs(posts: DataFrame, percent: int, exact: bool = False) -> DataFrame:
    """(hub, doc) for the members of each posting list whose sizes allow the similarity."""
    hubs = posts.groupBy("key").agg(F.max(F.struct("shared", (-F.col("doc")).alias("neg"), F.col("n").alias("hub_n"), "rest")).alias("h"))
    hubs = hubs.select(F.col("key").alias("key_"), (-F.col("h.neg")).alias("hub"), F.col("h.hub_n").alias("hub_n"), F.col("h.shared").alias("hub_shared"), F.col("h.rest").alias("hub_rest"))
    pairs = posts.join(hubs, posts["key"] == hubs["key_"]).where("doc <> hub").where(possible(percent, exact))
    return pairs.select(F.greatest("hub", "doc").alias("x"), F.least("hub", "doc").alias("y"), "hub", "doc").dropDuplicates(["x", "y"]).select("hub", "doc")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int, least: int) -> DataFrame:
    """hub, doc of the pairs that collide often enough (``least`` 0: any) and whose full sets are similar enough.

    ``sets``: doc, sig, shingles (sorted). Members stream past their hub's set;
    a hub with many members is copied to several tasks.
    """
    parts = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / HUB_MEMBERS).cast("int").alias("parts"))
    sized = pairs.join(parts.withColumnRenamed("hub", "hub_"), F.col("hub") == F.col("hub_")).select("hub", "doc", F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("role"))
    heads = parts.select("hub", F.col("hub").alias("doc"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"))
    s = sets.withColumnRenamed("doc", "set_doc")
    rows = sized.unionByName(heads).join(s, F.col("doc") == F.col("set_doc")).select("hub", "part", "role", "doc", "sig", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, head_sig, head = None, None, None
        for b in batches:
            hubs, parts_, roles, docs = (b.column(i).to_pylist() for i in range(4))
            sigs, sets_ = b.column(4), b.column(5)
            out: list[tuple[int, int]] = []
            for i, (hub, part, role, doc) in enumerate(zip(hubs, parts_, roles, docs, strict=True)):
                sig, own = (np.asarray(c[i].values) for c in (sigs, sets_))
                if role == 0:
                    now, head_sig, head = (hub, part), sig, own
                    continue
                if now != (hub, part):
                    raise ValueError("a member came without its hub")
                if (sig == head_sig).sum() < least:
                    continue
                at = np.minimum(np.searchsorted(head, own), len(head) - 1)
                both = int((head[at] == own).sum())
                if 100 * both >= percent * (len(own) + len(head) - both):
                    out.append((hub, doc))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["hub", "doc"])

    dealt = rows.repartition("hub", "part").sortWithinPartitions("hub", "part", "role")
    return dealt.mapInArrow(run, "hub long, doc long")


def connected(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, comp: the smallest node of each component of the graph. Labels spread along edges and jump to their own labels."""
    both = spool(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).union(edges.select(F.col(b), F.col(a))), "edges")
    labels = spool(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("comp")), "labels")
    while True:
        told = both.join(shuffled(labels), both["v"] == labels["node"]).groupBy("u").agg(F.min("comp").alias("near"))
        next_ = labels.join(shuffled(told), labels["node"] == told["u"], "left").select("node", "comp", F.least("comp", F.coalesce("near", "comp")).alias("new"))
        goal = labels.select(F.col("node").alias("at"), F.col("comp").alias("beyond"))
        step = spool(next_.join(shuffled(goal), next_["new"] == goal["at"], "left").select("node", F.least("new", F.coalesce("beyond", "new")).alias("comp"), (F.least("new", F.coalesce("beyond", "new")) < F.col("comp")).alias("moved")), "labels")
        labels = step.select("node", "comp")
        if step.where("moved").isEmpty():
            return labels


def _spread(posts: DataFrame, comps: DataFrame) -> DataFrame:
    """posts with comp, of the lists that span several components."""
    c = comps.withColumnRenamed("comp", "comp_")
    with_comp = posts.join(c, posts["doc"] == c["node"], "left").select("key", "doc", "n", "shared", "rest", F.coalesce("comp_", "doc").alias("comp"))
    wide = with_comp.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select(F.col("key").alias("key_"))
    return with_comp.join(wide, with_comp["key"] == wide["key_"], "left_semi")


def _across(spread: DataFrame, percent: int) -> DataFrame:
    """(hub, doc): pairs of a list whose components differ and whose counts allow the similarity."""
    one = spread.select("key", "doc", "n", "shared", "rest", "comp")
    other = spread.select(F.col("key").alias("key_"), F.col("doc").alias("hub"), F.col("n").alias("hub_n"), F.col("shared").alias("hub_shared"), F.col("rest").alias("hub_rest"), F.col("comp").alias("hub_comp"))
    same = (one["key"] == other["key_"]) & (one["doc"] > other["hub"]) & (one["comp"] != other["hub_comp"]) & F.expr(possible(percent, True))
    return one.join(other, same).select("hub", "doc").distinct()


def _merge(comps: DataFrame, links: DataFrame) -> DataFrame:
    """comps after more links between nodes."""
    if links.isEmpty():
        return comps
    c = comps.withColumnRenamed("comp", "comp_").withColumnRenamed("node", "node_")
    a = links.join(c, links["hub"] == c["node_"], "left").select("doc", F.coalesce("comp_", "hub").alias("p"))
    b = a.join(c, a["doc"] == c["node_"], "left").select("p", F.coalesce("comp_", "doc").alias("q"))
    roots = connected(b.where("p <> q"), "p", "q").withColumnRenamed("comp", "root").withColumnRenamed("node", "old")
    known = comps.unionByName(links.select(F.col("doc").alias("node"), F.col("doc").alias("comp"))).unionByName(links.select(F.col("hub").alias("node"), F.col("hub").alias("comp"))).groupBy("node").agg(F.min("comp").alias("comp"))
    return spool(known.join(roots, known["comp"] == roots["old"], "left").select("node", F.coalesce("root", "comp").alias("comp")), "comps")


def components(docs: DataFrame, width: int = 5, percent: int = 80, coordinates: int = COORDINATES, least: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of ``docs``."""
    least = least or max(1, int(coordinates * (percent / 100) - 4.7 * (coordinates * (percent / 100) * (1 - percent / 100)) ** 0.5 + 0.5))
    texts = id_text(docs, id_col, text_col)
    rows = spool(signed(texts, width, coordinates), "signed")
    classes = rows.where("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"))
    classes = spool(classes.where("rep IS NOT NULL").select(F.col("k1").alias("c1"), F.col("k2").alias("c2"), "rep"), "classes")
    # One row for each distinct set.
    reps = rows.join(shuffled(classes), (rows["k1"] == classes["c1"]) & (rows["k2"] == classes["c2"]) & (rows["doc_id"] == classes["rep"])).dropDuplicates(["k1", "k2"])
    reps = spool(reps.select("doc_id", "n", "sig"), "reps")
    posts = reps.select(F.col("doc_id").alias("doc"), "n", F.lit(coordinates).alias("size"), F.explode("sig").alias("key"))
    posts = spool(rarest_first(posts, f"{coordinates - least + 1}"), "posts")
    stars = spool(hub_pairs(posts, percent), "stars")
    wanted = posts.select(F.col("doc").alias("wanted")).distinct()
    candidates = texts.where("doc_id IS NOT NULL").join(shuffled(wanted), texts["doc_id"] == F.col("wanted"), "left_semi")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, some in text_batches(batches):
            own = shingle_sets([x or "" for x in some], width)
            sig = iter(signatures(own, coordinates))
            kept = [(k, next(sig), s.view(np.int64)) for k, s in zip(keys, own, strict=True) if len(s)]
            kept = [(k, g, s[np.argsort(s)]) for k, g, s in kept]
            if kept:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in kept], pa.int64()), pa.array([g for _, g, _ in kept], pa.list_(pa.int64())), pa.array([s for _, _, s in kept], pa.list_(pa.int64()))], ["doc", "sig", "shingles"])

    sets = spool(candidates.mapInArrow(build, "doc long, sig array<long>, shingles array<long>").dropDuplicates(["doc"]), "sets")
    links = spool(confirm(stars, sets, percent, least), "links")
    comps = connected(links, "hub", "doc")
    mixed_lists = spool(_spread(posts, comps).select(F.col("doc").alias("wanted")).distinct(), "spread")
    if not mixed_lists.isEmpty():
        # Their sets meet again on a prefix of their own shingles, rarest among these sets first.
        members = sets.join(mixed_lists, sets["doc"] == mixed_lists["wanted"], "left_semi")
        shingles = members.select("doc", F.size("shingles").cast("long").alias("n"), F.explode("shingles").alias("key")).withColumn("size", F.col("n"))
        exact = spool(rarest_first(shingles, f"n - cast(ceil(n * {percent} / 100) as int) + 1"), "posts")
        first = hub_pairs(_spread(exact, comps), percent, exact=True)
        comps = _merge(comps, spool(confirm(first, sets, percent, 0), "links"))
        comps = _merge(comps, spool(confirm(_across(_spread(exact, comps), percent), sets, percent, 0), "links"))
    own = rows.join(shuffled(classes), (rows["k1"] == classes["c1"]) & (rows["k2"] == classes["c2"]) & (rows["n"] > 0), "left").select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep"))
    final = comps.withColumnRenamed("comp", "comp_")
    out = own.join(final, own["rep"] == final["node"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("comp_", "rep")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stand for their component (smallest id), with all their columns; rows without an id stay."""
    gone = components(docs, id_col=id_col, text_col=text_col, **options).where("NOT kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs[id_col].cast("long") == gone["__gone"], "left_anti")


def op6_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents"), width=3, percent=85)
