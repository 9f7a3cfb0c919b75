"""Token ids on disk as Re-Pair grammars (operator 7).

Documents are ordered by id and encoded; shards of about two million ids are
compressed each by a grammar of its own: frequent neighbouring pairs become
nonterminals, round by round, until no pair occurs LEAST_USES times (a rule
takes the room of three symbols, so that four uses are the first that save),
never across the end of a document. A round takes the pairs that occur at least a
third as often as the most frequent one, or less often ones until they make up
a fifth of the places. A shard holds its documents' places,
the rules with their expansion lengths, and the remaining symbols, so any range
of ids can be decoded without the rest. Shards are rows of a Parquet dataset,
which every file system that Spark knows can hold.

Shard layout, little endian: magic ``RPG2``; counts of documents, rules and
symbols (3 x u64) and of ids (u64); vocabulary size (u32), one u32 of zero; ids
of the documents (i64); their first symbols (u64); their id counts (u64); rules'
left symbols, right symbols (32 bits: all low halves, then all high ones, u16
each); rules' expansion lengths (u32); symbols (32 bits, in halves like those).

Defined results: a null or empty text is its end id alone; rows with equal ids
keep all their ids, in an order that Spark chooses; a null id sorts first; an
empty table writes no shard; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm import bpe
from weftline.llm.common import id_text, partitions, shared_dir, table, text_batches

MAGIC = b"RPG2"
SHARD_IDS = 2_000_000
VOCABULARY = 50_257
#: A pair of fewer occurrences is not replaced: a rule holds three numbers, and each use saves one.
LEAST_USES = 4
NULL_ID = -(1 << 63)
#: A round takes at least a third of the most frequent pair's count, and one in so many places.
FULL_ROUND = 5
#: Pairs are counted by the high bits of a product; pairs that share them only make a count too large, which is then taken exactly.
HASH, SLOT_BITS = np.uint64(0x9E3779B97F4A7C15), 20
NO_SLOT = 1 << SLOT_BITS


def compress(ids: np.ndarray, starts: np.ndarray, vocabulary: int = VOCABULARY) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, first symbol of each document, rules as (left, right), expansion lengths). Documents hold an id at least.

    Pairs are counted once; from then on a replacement takes from the counts the pairs it ends, and adds those it makes.
    """
    seq, n = ids.astype(np.uint32), len(ids)
    bound = np.zeros(n, bool)  # a document's last symbol
    bound[starts[1:].astype(np.int64) - 1] = True
    bound[-1:] = True

    def pairs_at(at: np.ndarray) -> np.ndarray:
        return (seq.take(at).astype(np.uint64) << np.uint64(32)) | seq.take(at + 1)

    def slots_at(at: np.ndarray) -> np.ndarray:
        own = (pairs_at(np.minimum(at, max(len(seq) - 2, 0))) * HASH >> np.uint64(64 - SLOT_BITS)).astype(np.int32)
        own[bound[at]] = NO_SLOT
        return own

    slot = np.full(n, NO_SLOT, np.int32)
    slot[:-1] = ((seq[:-1].astype(np.uint64) << np.uint64(32)) | seq[1:]) * HASH >> np.uint64(64 - SLOT_BITS)
    slot[bound] = NO_SLOT
    counts = np.bincount(slot, minlength=NO_SLOT + 1)
    rules, lengths = [np.zeros((0, 2), np.uint32)], [np.ones(vocabulary, np.uint32)]
    made, most = 0, n
    while True:
        counts[NO_SLOT] = 0
        busy = np.sort(counts[counts >= LEAST_USES])[::-1]
        if not len(busy):
            break
        full = busy[min(int(np.searchsorted(np.cumsum(busy), len(seq) // FULL_ROUND)), len(busy) - 1)]
        floor = max(LEAST_USES, min(int(busy[0]) // 3, int(full)))
        while True:
            at = np.flatnonzero((counts >= floor).take(slot))
            found = pa.array(pairs_at(at)).dictionary_encode()
            which, new = found.indices.to_numpy(), found.dictionary.to_numpy()
            count = np.bincount(which, minlength=len(new))
            if floor == LEAST_USES or count.size and count.max() >= floor:
                break
            floor = max(LEAST_USES, floor // 2)  # several pairs made up the fullest slots
        good = count >= floor
        if not good.any():
            break
        if good.sum() > most:
            good &= np.isin(np.arange(len(new)), np.argsort(-count, kind="stable")[:most])
        hit = good[which]
        at, which = at[hit], which[hit]
        # Of neighbouring occurrences every second one stands, from the left.
        run = np.flatnonzero(np.diff(at, prepend=-2) != 1)
        odd = (np.arange(len(at)) - np.repeat(run, np.diff(run, append=len(at)))) % 2 == 1
        at, which = at[~odd], which[~odd]
        stand = np.bincount(which, minlength=len(new))
        good = stand >= floor
        if not good.any():  # of overlapping ones at least half stand
            good = stand >= LEAST_USES // 2
        if not good.any():  # they stand in each other's way; a single pair never does
            most = max(1, min(most, len(new)) // 16)
            continue
        most = n
        name = np.cumsum(good) - 1
        at, which = at[good[which]], name[which[good[which]]]
        new = new[good]
        left, right = (new >> np.uint64(32)).astype(np.uint32), (new & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        known = np.concatenate(lengths)
        lengths = [known, known[left] + known[right]]
        rules.append(np.stack([left, right], 1))
        free = np.diff(at, prepend=-3) > 2  # the pair before is not one that the last replacement ends too
        free[0] &= at[0] > 0
        np.subtract.at(counts, slot[np.concatenate([at, at + 1, at[free] - 1])].astype(np.int64), 1)
        seq[at] = (vocabulary + made + which).astype(np.uint32)
        bound[at] = bound[at + 1]
        made += len(new)
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq, bound, slot = seq[keep], bound[keep], slot[keep]
        at -= np.arange(len(at))
        fresh = np.concatenate([at, at[free] - 1])
        if len(seq) > 1:
            slot[fresh] = slots_at(fresh)
        else:
            slot[:] = NO_SLOT
        np.add.at(counts, slot[fresh].astype(np.int64), 1)
    first = np.append(0, np.flatnonzero(bound)[:-1] + 1)
    return seq, first, np.concatenate(rules), np.concatenate(lengths)[vocabulary:]


def _planes(symbols: np.ndarray) -> bytes:
    """Low and high halves apart: the high ones are nearly all alike, which a file's own compression takes away."""
    return (symbols & np.uint32(0xFFFF)).astype("<u2").tobytes() + (symbols >> np.uint32(16)).astype("<u2").tobytes()


def pack_shard(doc_ids: list[int | None], docs: list[np.ndarray], vocabulary: int = VOCABULARY) -> bytes:
    """The shard of documents whose ids are less than ``vocabulary``."""
    sizes = np.array([len(x) for x in docs], np.uint64)
    starts = np.cumsum(sizes) - sizes
    ids = np.concatenate(docs)
    if len(ids) and int(ids.max()) >= vocabulary:
        raise ValueError(f"id {int(ids.max())} is not of a vocabulary of {vocabulary}")
    seq, first, rules, lengths = compress(ids, starts, vocabulary)
    keys = np.array([NULL_ID if x is None else x for x in doc_ids], "<i8")
    head = MAGIC + struct.pack("<4Q2I", len(docs), len(rules), len(seq), int(sizes.sum()), vocabulary, 0)
    return b"".join([head, keys.tobytes(), first.astype("<u8").tobytes(), sizes.astype("<u8").tobytes(), _planes(rules[:, 0]), _planes(rules[:, 1]), lengths.astype("<u4").tobytes(), _planes(seq)])


class Shard:
    """A shard as it lies in memory; nothing is expanded until asked for."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a shard")
        n, rules, symbols, self.n_ids, self.vocabulary, _ = struct.unpack_from("<4Q2I", data, 4)
        at = 4 + struct.calcsize("<4Q2I")

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, count, at)
            at += out.nbytes
            return out

        self.doc_ids, self.first, self.sizes = take("<i8", n), take("<u8", n).astype(np.int64), take("<u8", n).astype(np.int64)

        def symbols_of(count: int) -> np.ndarray:
            low = take("<u2", count).astype(np.uint32)
            return low | take("<u2", count).astype(np.uint32) << np.uint32(16)

        self.left, self.right = symbols_of(rules), symbols_of(rules)
        self.lengths = np.concatenate([np.ones(self.vocabulary, np.int64), take("<u4", rules).astype(np.int64)])
        self.symbols = symbols_of(symbols)
        self._flat: tuple[np.ndarray, np.ndarray] | None = None

    def _expansions(self) -> tuple[np.ndarray, np.ndarray]:
        """Every symbol's ids one after another, and where each symbol's start; rules only use earlier symbols."""
        if self._flat is None:
            at = np.cumsum(self.lengths) - self.lengths
            flat = np.empty(int(self.lengths.sum()), np.uint32)
            flat[: self.vocabulary] = np.arange(self.vocabulary)
            v, starts = self.vocabulary, at.tolist()
            for i, (a, b) in enumerate(zip(self.left.tolist(), self.right.tolist(), strict=True), v):
                la, lb = int(self.lengths[a]), int(self.lengths[b])
                s = starts[i]
                flat[s : s + la] = flat[starts[a] : starts[a] + la]
                flat[s + la : s + la + lb] = flat[starts[b] : starts[b] + lb]
            self._flat = flat, at
        return self._flat

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        flat, at = self._expansions()
        size = self.lengths.take(symbols)
        before = np.cumsum(size)
        total = int(before[-1]) if len(before) else 0
        narrow = np.int32 if max(total, len(flat)) < 1 << 31 else np.int64
        shift = (at.take(symbols) - before + size).astype(narrow)
        return flat.take(np.repeat(shift, size) + np.arange(total, dtype=narrow))

    def document(self, i: int, start: int = 0, end: int | None = None) -> np.ndarray:
        """Ids [start, end) of the i-th document. Symbols that lie outside are skipped by their lengths, and so are the parts of rules."""
        last = int(self.first[i + 1]) if i + 1 < len(self.first) else len(self.symbols)
        symbols = self.symbols[int(self.first[i]) : last]
        end = int(self.sizes[i]) if end is None else min(end, int(self.sizes[i]))
        reach = np.cumsum(self.lengths[symbols])
        a, b = int(np.searchsorted(reach, start, "right")), int(np.searchsorted(reach, end, "left")) + 1
        at = int(reach[a - 1]) if a else 0
        out: list[int] = []
        pending = symbols[a:b].tolist()[::-1]
        while pending and at < end:
            symbol = pending.pop()
            size = int(self.lengths[symbol])
            if at + size <= start:
                at += size
            elif symbol < self.vocabulary:
                out.append(symbol)
                at += 1
            else:
                pending += [int(self.right[symbol - self.vocabulary]), int(self.left[symbol - self.vocabulary])]
        return np.array(out, np.uint32)


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the shards of ``docs`` in ascending order of id: columns task, shard, n_ids, data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        cache, task = bpe.rank_cache(vocabulary), TaskContext.get().partitionId()
        keys, held, size, shard = [], [], 0, 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([task], pa.int32()), pa.array([shard], pa.int32()), pa.array([size], pa.int64()), pa.array([pack_shard(keys, held)], pa.binary())], ["task", "shard", "n_ids", "data"])

        for some, texts in text_batches(batches, bpe.ENCODE_CHARS, bpe.ENCODE_ROWS):
            for key, ids in zip(some, bpe.encode_texts([x or "" for x in texts], cache), strict=True):
                keys.append(key)
                held.append(np.append(ids, np.uint16(end_id)))
                size += len(ids) + 1
                if size >= SHARD_IDS:
                    yield flush()
                    keys, held, size, shard = [], [], 0, shard + 1
        if keys:
            yield flush()

    rows = id_text(docs, id_col, text_col).repartitionByRange(partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id")
    rows.mapInArrow(run, "task int, shard int, n_ids long, data binary").write.mode("overwrite").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone."""
    shards = spark.read.schema("task int, shard int, n_ids long, data binary").parquet(path)
    sizes = shards.select("task", "shard", "n_ids")
    # Shards before one of the same task, then tasks before it: a row a task, as many as there were partitions.
    tasks = sizes.groupBy("task").agg(F.sum("n_ids").alias("n"))
    before = tasks.select(F.col("task").alias("task_"), (F.sum("n").over(Window.orderBy("task")) - F.col("n")).alias("task_start"))
    own = Window.partitionBy("task").orderBy("shard")
    starts = sizes.select(F.col("task").alias("task_"), F.col("shard").alias("shard_"), (F.sum("n_ids").over(own) - F.col("n_ids")).alias("shard_start")).join(before, "task_")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for task, shard, data in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                s = Shard(data)
                ids = s.expand(s.symbols).astype("<u4", copy=False)
                at = np.cumsum(s.sizes) - s.sizes
                crc = [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(at.tolist(), s.sizes.tolist(), strict=True)]
                keys = [None if x == NULL_ID else x for x in s.doc_ids.tolist()]
                n = len(keys)
                yield pa.RecordBatch.from_arrays([pa.array([task] * n, pa.int32()), pa.array([shard] * n, pa.int32()), pa.array(keys, pa.int64()), pa.array(at), pa.array(s.sizes), pa.array(crc, pa.int64())], ["task", "shard", "doc_id", "own_start", "n_tokens", "ids_crc32"])

    rows = shards.select("task", "shard", "data").mapInArrow(run, "task int, shard int, doc_id long, own_start long, n_tokens long, ids_crc32 long")
    joined = rows.join(F.broadcast(starts) if _few(spark, path) else starts, (rows["task"] == starts["task_"]) & (rows["shard"] == starts["shard_"]))
    return joined.select("doc_id", (F.col("own_start") + F.col("shard_start") + F.col("task_start")).alias("start"), "n_tokens", "ids_crc32")


def _few(spark: SparkSession, path: str) -> bool:
    """Whether the table of shards' starts is small enough to broadcast (24 bytes a shard)."""
    return spark.read.schema("shard int").parquet(path).count() <= 200_000


def op7_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{shared_dir(spark)}/repair-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return read(spark, path)
