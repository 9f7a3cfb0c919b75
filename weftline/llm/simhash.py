"""SimHash near-duplicates found through Golay-code keys (operator 11).

A document's fingerprint holds, for each of 64 bits, whether over half of its
shingle hashes set it. Fingerprints at most three bits apart are linked.

The 64 bits are three segments of 22, 21 and 21 bits, each a word of the binary
Golay code of length 23, in which every word lies at most three bits from
exactly one codeword. A segment's *centre* is the index of that codeword; its
*neighbourhood* holds the centres of the segment and of all that one flipped
bit makes of it, at most six. Two segments at most one bit apart have each
other's centre in their neighbourhoods.

Three errors over three segments leave two cases. Either one segment has none
and another at most one: the key is the first segment itself and a centre of
the second, for each of the six ordered pairs. Or each segment has one: the key
is three centres. Fingerprints *post* one side of a key and *probe* the other,
so that every linked pair meets at a key, and pairs that do not belong together
hardly ever do (5e-9 of those of random fingerprints). Distances are then
verified in full.

No key emits the pairs of a large group. Keys with more than ``crowd`` posts or
probes are left out of the join, and their fingerprints meet at midpoints
instead: two fingerprints at most three bits apart have a word at most one bit
from one and two from the other. All fingerprints within two bits of a word are
linked to one of those within one bit of it; such links are all real, and make
the same components as all pairs do. A word has at most 2081 neighbours, however
many rows there are.

Defined results: a null, empty or blank text has fingerprint zero and is linked
as any other; a text with fewer words than a shingle is one shingle; equal
fingerprints are linked; rows with equal ids are rows of their own; a row
without an id gets the component of its fingerprint, null if no row there has an
id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import id_text, shuffled, spool, table, text_batches
from weftline.llm.near_dup import connected

SEED = 42
DISTANCE = 3
#: Bits of each segment, and how far right it stands in the fingerprint.
SEGMENTS = ((22, 42), (21, 21), (21, 0))
#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 generates the Golay code.
GENERATOR, CHECK_BITS, CODE_BITS = 0xC75, 11, 23
#: Posts or probes of a key that the join takes.
CROWD = 2048
#: Shingles whose bits are counted at once.
BLOCK = 1 << 15


def normal_words(text: str) -> tuple[bytes, list[int], list[int]]:
    """The lower-cased words joined by single spaces, and each word's first byte and end."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    ends = np.cumsum([len(w) + 1 for w in words], dtype=np.int64) - 1
    return b" ".join(words), [0, *(ends[:-1] + 1).tolist()] if words else [], ends.tolist()


def fingerprint(text: str, width: int = 3) -> int:
    """The majority of each bit over the shingle hashes, repeats counted."""
    joined, starts, ends = normal_words(text)
    if not starts:
        return 0
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :], strict=False)] or [digest(joined, SEED)]
    if len(hashes) == 1:
        return hashes[0]
    bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK):
        part = np.array(hashes[at : at + BLOCK], ">u8").view(np.uint8).reshape(-1, 8)
        bits += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > len(hashes)).tobytes(), "big")


def signed(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, fp long (the fingerprint's bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in text_batches(batches):
            prints = np.array([fingerprint(x or "", width) for x in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(prints.view(np.int64))], ["doc_id", "fp"])

    return docs.mapInArrow(run, "doc_id long, fp long")


def _remainder(word: int) -> int:
    for at in range(CODE_BITS - 1, CHECK_BITS - 1, -1):
        if word >> at & 1:
            word ^= GENERATOR << (at - CHECK_BITS)
    return word


@lru_cache(1)
def decoder() -> tuple[np.ndarray, np.ndarray]:
    """The remainder of each single bit, and for each remainder the one error of at most three bits that leaves it."""
    single = np.array([_remainder(1 << i) for i in range(CODE_BITS)], np.int32)
    errors = np.zeros(1 << CHECK_BITS, np.int32)
    for weight in (1, 2, 3):
        for at in combinations(range(CODE_BITS), weight):
            errors[np.bitwise_xor.reduce(single[list(at)])] = sum(1 << i for i in at)
    return single, errors


def centres(words: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each word its centre (n), and its neighbourhood (n, 6): distinct centres in order, -1 beyond them."""
    single, errors = decoder()
    words = words.astype(np.int32)
    left = np.zeros(len(words), np.int32)
    for i in range(bits):
        left ^= np.where(words >> i & 1, single[i], 0)
    flips = np.concatenate([[0], 1 << np.arange(bits)]).astype(np.int32)
    near = words[:, None] ^ flips
    codes = (near ^ errors[left[:, None] ^ np.concatenate([[0], single[:bits]])]) >> CHECK_BITS
    ordered = np.sort(codes, 1)
    new = np.ones(ordered.shape, bool)
    new[:, 1:] = ordered[:, 1:] != ordered[:, :-1]
    out = np.full((len(words), 6), -1, np.int32)
    row, col = np.nonzero(new)
    out[row, (np.cumsum(new, 1) - 1)[row, col]] = ordered[row, col]
    return codes[:, 0], out


def golay_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the fingerprint, key, whether it probes) of all keys."""
    values = prints.view(np.uint64)
    parts = [((values >> np.uint64(shift)) & np.uint64((1 << bits) - 1)).astype(np.int64) for bits, shift in SEGMENTS]
    found = [centres(p, bits) for p, (bits, _) in zip(parts, SEGMENTS, strict=True)]
    centre = [c.astype(np.int64) for c, _ in found]
    near = [k.astype(np.int64) for _, k in found]
    rows, keys, probes = [], [], []

    def add(key: np.ndarray, held: np.ndarray, probe: bool) -> None:
        at = np.nonzero(held)
        rows.append(at[0])
        keys.append(np.broadcast_to(key, held.shape)[at])
        probes.append(np.full(len(at[0]), probe))

    case = 0
    for i in range(3):
        for j in range(3):
            if i != j:
                exact = (case << 36) | parts[i] << 12
                add(exact | centre[j], np.ones(len(prints), bool), False)
                add(exact[:, None] | np.maximum(near[j], 0), near[j] >= 0, True)
                case += 1
    three = case << 36
    add(three | (centre[1] << 12 | centre[2])[:, None] | np.maximum(near[0], 0) << 24, near[0] >= 0, False)
    held = (near[1] >= 0)[:, :, None] & (near[2] >= 0)[:, None, :]
    add(three | (centre[0] << 24)[:, None, None] | (np.maximum(near[1], 0) << 12)[:, :, None] | np.maximum(near[2], 0)[:, None, :], held, True)
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(probes)


def keyed(prints: DataFrame) -> DataFrame:
    """key, fp, probe of each fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                fps = np.array(b.column(0).slice(at, 1024))
                row, key, probe = golay_keys(fps)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fps[row]), pa.array(probe)], ["key", "fp", "probe"])

    return prints.select("fp").mapInArrow(run, "key long, fp long, probe boolean")


def midpoint_links(prints: DataFrame) -> DataFrame:
    """u, v: real links between the fingerprints that make the components of all links among them."""
    bit = [1 << i for i in range(64)]
    once = [0, *bit]
    twice = [a | b for a, b in combinations(bit, 2)]
    signed64 = lambda x: x - (1 << 64) if x >> 63 else x
    words = lambda masks: F.explode(F.transform(F.array(*(F.lit(signed64(m)) for m in masks)), lambda m: m.bitwiseXOR(F.col("fp"))))
    hubs = spool(prints.select(words(once).alias("word"), "fp").groupBy("word").agg(F.min("fp").alias("u")), "hubs")
    members = prints.select(words(once + twice).alias("at"), F.col("fp").alias("v"))
    return members.join(shuffled(hubs), members["at"] == hubs["word"]).where("u <> v").select("u", "v").distinct()


def links(prints: DataFrame, crowd: int = CROWD) -> DataFrame:
    """u, v: links between the distinct fingerprints ``prints`` (fp)."""
    keys = keyed(prints)
    side = lambda probe: F.count(F.when(F.col("probe") == F.lit(probe), 1))
    crowded = spool(keys.groupBy("key").agg(side(False).alias("posts"), side(True).alias("probes")).where(f"posts > {crowd} OR probes > {crowd}").select(F.col("key").alias("full")), "crowded")
    more = None
    if not crowded.isEmpty():
        inside = keys.join(crowded, keys["key"] == crowded["full"], "left_semi").select("fp").distinct()
        more = midpoint_links(spool(inside, "inside"))
        keys = keys.join(crowded, keys["key"] == crowded["full"], "left_anti")
    posts = keys.where("NOT probe").select(F.col("key").alias("k"), F.col("fp").alias("u"))
    probes = keys.where("probe").select("key", F.col("fp").alias("v"))
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= DISTANCE
    met = posts.join(shuffled(probes), (posts["k"] == probes["key"]) & (F.col("u") < F.col("v")) & near).select("u", "v").distinct()
    return met if more is None else met.unionByName(more)


def components(docs: DataFrame, width: int = 3, crowd: int = CROWD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint, component_id, n_equal (rows with the same fingerprint): one row for each row of ``docs``."""
    rows = spool(signed(id_text(docs, id_col, text_col), width), "prints")
    classes = spool(rows.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")), "classes")
    edges = spool(links(classes, crowd), "links")
    comps = connected(edges, "u", "v")
    joined = classes.join(shuffled(comps), classes["fp"] == comps["node"], "left").select("fp", "rep", "n", "comp")
    roots = joined.where("comp IS NOT NULL").groupBy(F.col("comp").alias("root")).agg(F.min("rep").alias("least"))
    told = joined.join(shuffled(roots), joined["comp"] == roots["root"], "left").where("n > 1 OR comp IS NOT NULL")
    told = spool(told.select(F.col("fp").alias("print"), F.coalesce("least", "rep").alias("component"), "n"), "told")
    out = rows.join(shuffled(told), rows["fp"] == told["print"], "left")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.coalesce("component", "doc_id").alias("component_id"), F.coalesce("n", F.lit(1)).alias("n_equal"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stand for their component (smallest id), with all their columns; rows without an id stay."""
    gone = components(docs, id_col=id_col, text_col=text_col, **options).where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs[id_col].cast("long") == gone["__gone"], "left_anti")


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents"))
