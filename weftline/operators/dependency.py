"""Dependencies added by hand: keys resolved over the whole project, written to one tracker or to all that know both ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from weftline.functions import chars

# Characters that may be set by hand.
ALLOWED = ("<", ">", "x", "d", "s", "S", "n", "o", "p", ".")


def _asked(want: Column) -> tuple[Column, Column, Column]:
    """(key, instance or null, whether the instance is a number) of ``key#instance``."""
    parts = F.split(want, "#")
    said = F.try_element_at(parts, F.lit(2))
    return parts[0], said.try_cast("int"), said.isNull() | said.rlike(r"^\s*[+-]?\d+\s*$")


def resolve(requests: DataFrame, nodes: DataFrame, side: str) -> DataFrame:
    """requests with <side>_path and <side>_why: null, or ``bad instance``, ``unknown`` or ``ambiguous``; and <side>_trackers, where nodes have trackers.

    Paths that share a key are its instances, numbered in order of path; a key alone means its only path. Each request
    meets one node: the instance it names, or the first, which says how many there are.
    """
    own = Window.partitionBy("key")
    more = [c for c in ("trackers",) if c in nodes.columns]
    numbered = nodes.select(F.col("key").alias("n_key"), F.col("path").alias("n_path"), F.row_number().over(own.orderBy("path")).alias("nth"), F.count(F.lit(1)).over(own).alias("n"), *(F.col(c).alias(f"{side}_{c}") for c in more))
    key, instance, number = _asked(F.col(side))
    r = requests.withColumns({"w_key": key, "w_instance": instance, "w_number": number})
    r = r.join(numbered, (F.col("w_key") == F.col("n_key")) & (F.coalesce("w_instance", F.lit(1)) == F.col("nth")), "left")
    why = F.when(~F.col("w_number"), "bad instance").when(F.col("w_instance").isNull() & (F.col("n") > 1), "ambiguous").when(F.col("n_path").isNull(), "unknown")
    return r.withColumns({f"{side}_path": F.when(why.isNull(), F.col("n_path")), f"{side}_why": why}).drop("w_key", "w_instance", "w_number", "n", "n_key", "n_path", "nth")


def outcomes(requests: DataFrame, nodes: DataFrame, defs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(outcomes, writes) of requests: request, source, target, dep, tracker (null: all that fit).

    ``nodes``: key, path. ``defs``: tracker, path. A request with several targets is several rows. Outcomes give each
    row a status and how many trackers take it: ``ok``; ``bad type``; ``source ...`` and ``target ...`` for keys that do
    not resolve; ``self``; ``no tracker``, where the named one is unknown or none knows the source and a target of the
    request. Writes are tracker, src, dst, ch, request, with the opposite cell for directed and mutual characters; in a
    tracker found by itself, only where it knows both ends.
    """
    d = defs.select(F.col("tracker").alias("t"), F.col("path").alias("p"))
    # The trackers that know a path travel with it, so that both ends of a request are settled in one row.
    known = d.groupBy("p").agg(F.collect_set("t").alias("trackers"))
    at = nodes.join(known, F.col("path") == F.col("p"), "left").select("key", "path", "trackers")
    r = resolve(resolve(requests, at, "source"), at, "target")
    why = (
        F.when(~F.col("dep").isin(*ALLOWED), "bad type")
        .when(F.col("source_why").isNotNull(), F.concat(F.lit("source "), "source_why"))
        .when(F.col("target_why").isNotNull(), F.concat(F.lit("target "), "target_why"))
        .when(F.col("source_path") == F.col("target_path"), "self")
    )
    names = d.where("t IS NOT NULL").select("t").distinct()  # as many rows as trackers
    r = r.join(F.broadcast(names), F.col("tracker") == F.col("t"), "left")
    takers = F.when(why.isNotNull(), None).when(F.col("t").isNotNull(), F.array("t")).when(F.col("tracker").isNull(), F.array_intersect("source_trackers", "target_trackers"))
    r = r.select("request", "source", "target", "dep", "source_path", "target_path", why.alias("why"), F.coalesce(takers, F.array().cast(ArrayType(d.schema["t"].dataType))).alias("takers"))
    # A request is heard where any of its targets is.
    heard = F.col("request").isNotNull() & F.max(F.size("takers") > 0).over(Window.partitionBy("request"))
    each = F.array_distinct(F.flatten(F.collect_list("takers").over(Window.partitionBy("request", "target"))))
    told = r.withColumn("heard", heard).withColumn("trackers", F.when(F.col("request").isNull(), 0).otherwise(F.size(each)).cast("long"))
    status = F.coalesce("why", F.when(F.col("heard"), "ok").otherwise("no tracker"))
    told = told.select("request", "source", "target", status.alias("status"), "trackers")
    writes = r.select("request", "target", F.explode("takers").alias("tracker"), F.col("source_path").alias("src"), F.col("target_path").alias("dst"), F.col("dep").alias("ch"))
    back = writes.select("request", "target", "tracker", F.col("dst").alias("src"), F.col("src").alias("dst"), chars.reciprocal(F.col("ch")).alias("ch")).where("ch IS NOT NULL")
    return told, writes.unionByName(back).select("tracker", "src", "dst", "ch", "request")


def write(cells: DataFrame, writes: DataFrame) -> DataFrame:
    """cells (tracker, src, dst, ch) after the writes, which win over any character; of several the last request's counts."""
    last = writes.groupBy("tracker", "src", "dst").agg(F.max_by("ch", F.struct("request", "ch")).alias("new"))
    return cells.join(last, ["tracker", "src", "dst"], "full_outer").select("tracker", "src", "dst", F.coalesce("new", "ch").alias("ch"))


def checklist(requests: DataFrame, nodes: DataFrame, is_doc: Column) -> DataFrame:
    """request, src, dst, dep of sound requests between a document and code. ``is_doc`` is an expression on ``path``."""
    r = resolve(resolve(requests, nodes, "source"), nodes, "target").where("source_path IS NOT NULL AND target_path IS NOT NULL AND source_path <> target_path")
    kind = nodes.select("path", is_doc.alias("doc")).distinct()
    a, b = kind.select(F.col("path").alias("a"), F.col("doc").alias("a_doc")), kind.select(F.col("path").alias("b"), F.col("doc").alias("b_doc"))
    j = r.join(a, F.col("source_path") == F.col("a")).join(b, F.col("target_path") == F.col("b")).where("a_doc <> b_doc")
    return j.where(F.col("dep").isin(*ALLOWED)).select("request", F.col("source_path").alias("src"), F.col("target_path").alias("dst"), "dep")
