"""Smaller scalar functions: cache keys, batch sizes, colours, diagram ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stops of the pipe colours, as red, green and blue.
PIPE_STOPS = ((96, 165, 250), (52, 211, 153), (250, 204, 21), (251, 146, 60), (239, 68, 68))
# Names too general to mean anything as a call, and low-value symbols.
GENERIC_CALLS = ("append", "get", "items", "join", "keys", "len", "print", "range", "split", "str", "values")


def similarity_key(a: Column, b: Column) -> Column:
    """The same for either order."""
    return F.concat(F.least(a, b), F.lit(":"), F.greatest(a, b))


def rerank_key(query: Column, candidates: Column, top_k: int, source: Column, instruction: Column) -> Column:
    """Independent of the order of candidates."""
    body = F.concat_ws("|", F.md5(query), F.md5(F.array_join(F.array_sort(candidates), "\n")), F.lit(str(top_k)), source, instruction)
    return F.substring(F.sha2(body, 256), 1, 16)


def batch_size(memory_gb: Column, context: Column) -> Column:
    """Texts at once: what memory remains over a text's share, between 1 and 50."""
    spare = memory_gb - F.greatest(F.lit(0.5), memory_gb * 0.1)
    return F.greatest(F.lit(1), F.least(F.lit(50), F.floor(spare / ((30 + context / 1000 * 120) / 1024)))).cast("int")


def pipe_colour(n: Column) -> Column:
    """Between five stops by the logarithm of the sources, the last from 64 on."""
    t = F.least(F.log2(n.cast("double")) / 6, F.lit(1.0)) * (len(PIPE_STOPS) - 1)
    i = F.least(F.floor(t), F.lit(len(PIPE_STOPS) - 2))
    stops = F.array(*(F.array(*map(F.lit, s)) for s in PIPE_STOPS))
    low, high = F.get(stops, i.cast("int")), F.get(stops, (i + 1).cast("int"))
    part = lambda k: F.lpad(F.hex(F.floor(F.get(low, F.lit(k)) + (F.get(high, F.lit(k)) - F.get(low, F.lit(k))) * (t - i) + 0.5).cast("long")), 2, "0")
    return F.lower(F.concat(F.lit("#"), part(0), part(1), part(2)))


def safe_id(key: Column) -> Column:
    return F.regexp_replace(key, "[^A-Za-z0-9_]", "_")


def useful_call(name: Column, local_roots: tuple[str, ...] = ()) -> Column:
    """A call that may lead somewhere in the project: not general, not a dunder, not a single letter."""
    last = F.element_at(F.split(name, r"\."), -1)
    plain = ~last.isin(*GENERIC_CALLS) & ~last.rlike(r"^__\w+__$") & (F.length(last) > 1)
    return plain & (F.lit(not local_roots) | F.split(name, r"\.")[0].isin(*local_roots) | ~name.contains("."))


def common_prefix(a: Column, b: Column) -> Column:
    """The deepest directory that two paths share."""
    pairs = F.zip_with(F.split(a, "/"), F.split(b, "/"), lambda x, y: F.struct(x.alias("x"), F.coalesce(x == y, F.lit(False)).alias("same")))
    kept = F.aggregate(pairs, F.struct(F.lit(True).alias("go"), F.expr("cast(array() as array<string>)").alias("p")), lambda s, z: F.when(s["go"] & z["same"], F.struct(F.lit(True).alias("go"), F.concat(s["p"], F.array(z["x"])).alias("p"))).otherwise(F.struct(F.lit(False).alias("go"), s["p"].alias("p"))))
    return F.array_join(kept["p"], "/")
