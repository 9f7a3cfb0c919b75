"""Merges of typed edges under the priority lattice.

Three rules differ on purpose. Across trackers the highest priority wins, a
verified ``n`` wins ties, and otherwise the greatest tracker. Combining
suggestions of one pair, opposite directions of equal priority become mutual
and otherwise the first wins. Rolling up a tree follows the second rule with
``x > n > <`` for what order would decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import chars


def across_trackers(cells: DataFrame) -> DataFrame:
    """tracker, src, dst, ch -> src, dst, ch, origins: one pass with partial aggregation, then the winners' trackers.

    The trackers of each character are gathered with the winner in one aggregation (at most one entry for each
    tracker and character), so no second shuffle is needed.
    """
    best = F.max_by("ch", F.struct(chars.priority(F.col("ch")), F.col("ch") == "n", "tracker"))
    merged = cells.groupBy("src", "dst").agg(best.alias("ch"), F.collect_set(F.struct("ch", "tracker")).alias("all"))
    own = F.array_sort(F.transform(F.filter("all", lambda x: x["ch"] == F.col("ch")), lambda x: x["tracker"]))
    return merged.select("src", "dst", "ch", own.alias("origins"))


def combined(best: Column, first: Column, lt: Column, gt: Column) -> Column:
    """Both directions at the top priority make ``x``; else what came first there."""
    return F.when((best == 5) & lt & gt, "x").otherwise(first)


def combine_suggestions(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Folds each pair's suggestions in order of ``seq``: higher priority replaces, ``<`` meeting ``>`` becomes x at priority 5."""
    ch, p = F.col("ch"), chars.priority(F.col("ch"))
    agg = edges.groupBy(*keys).agg(
        F.max(p).alias("best"),
        F.min_by("ch", F.struct((-p).alias("p"), F.col("seq"))).alias("first"),
        F.min(F.when(ch == "<", F.col("seq"))).alias("lt"),
        F.min(F.when(ch == ">", F.col("seq"))).alias("gt"),
    )
    # The first of priority 5 stays unless it is a direction that its opposite joins later; an n that came first stays.
    met = F.col("lt").isNotNull() & F.col("gt").isNotNull() & F.col("first").isin("<", ">")
    return agg.select(*keys, combined(F.col("best"), F.col("first"), met, met).alias("ch"))


def lattice(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Order-free form for roll-ups: x, then both directions (x), then n, then a direction, then by priority."""
    ch, p = F.col("ch"), chars.priority(F.col("ch"))
    has = lambda c: F.bool_or(ch == c)
    agg = edges.groupBy(*keys).agg(F.max(p).alias("best"), F.max_by("ch", F.struct(p, ch)).alias("top"), has("x").alias("x"), has("<").alias("lt"), has(">").alias("gt"), has("n").alias("n"))
    out = F.when(F.col("x") | (F.col("lt") & F.col("gt")), "x").when((F.col("best") == 5) & F.col("n"), "n").when(F.col("lt"), "<").when(F.col("gt"), ">").otherwise(F.col("top"))
    return agg.select(*keys, out.alias("ch"))


def module_edges(edges: DataFrame, modules: DataFrame) -> DataFrame:
    """src, dst (files) and modules (path, module) -> msrc, mdst, ch of pairs of different modules."""
    a = modules.select(F.col("path").alias("a"), F.col("module").alias("msrc"))
    b = modules.select(F.col("path").alias("b"), F.col("module").alias("mdst"))
    joined = edges.join(a, edges["src"] == a["a"]).join(b, edges["dst"] == b["b"]).where("msrc <> mdst")
    return lattice(joined.where(~F.col("ch").isin("p", "o", ".")).select("msrc", "mdst", "ch"), ["msrc", "mdst"])


def roll_up(edges: DataFrame, closure: DataFrame) -> DataFrame:
    """An ancestor inherits the edges of what lies below it, unless they stay inside it.

    The fix-point in one step: edges meet the closure of ancestors; no loop of jobs.
    """
    up = closure.select(F.col("ancestor"), F.col("node").alias("below"))
    lifted = edges.join(up, edges["src"] == up["below"]).select(F.col("ancestor").alias("src"), "dst", "ch").where("src <> dst")
    inside = closure.select(F.col("ancestor").alias("i_src"), F.col("node").alias("i_dst"))
    outer = lifted.join(inside, (lifted["src"] == inside["i_src"]) & (lifted["dst"] == inside["i_dst"]), "left_anti")
    return lattice(edges.select("src", "dst", "ch").unionByName(outer), ["src", "dst"]).where("ch <> 'p'")


def directory_pairs(pairs: DataFrame, edges: DataFrame, closure: DataFrame) -> DataFrame:
    """sdir, tdir -> verdict over all edges between what lies below: x for both directions, n for none, unresolved for weak."""
    s = closure.select(F.col("ancestor").alias("sdir"), F.col("node").alias("src"))
    t = closure.select(F.col("ancestor").alias("tdir"), F.col("node").alias("dst"))
    wanted_s, wanted_t = pairs.select("sdir").distinct(), pairs.select("tdir").distinct()
    below = edges.where(~F.col("ch").isin("o", ".")).join(s.join(wanted_s, "sdir", "left_semi"), "src").join(t.join(wanted_t, "tdir", "left_semi"), "dst")
    ch, p = F.col("ch"), chars.priority(F.col("ch"))
    best = below.groupBy("sdir", "tdir").agg(F.max_by("ch", F.struct(p, ch)).alias("top"), F.bool_or(ch == "<").alias("lt"), F.bool_or(ch == ">").alias("gt"), F.count(F.lit(1)).alias("n_edges"))
    joined = pairs.join(best, ["sdir", "tdir"], "left")
    verdict = F.when(F.col("top").isNull(), "n").when(F.col("lt") & F.col("gt"), "x").when(F.col("top").isin("p", "s", "S"), "unresolved").otherwise(F.col("top"))
    return joined.select("sdir", "tdir", verdict.alias("verdict"), F.coalesce("n_edges", F.lit(0)).alias("n_edges"))


def batch_rank(ch: Column) -> Column:
    """Order in a batch: priority, with n over weak characters, and weak suggestions over placeholders."""
    return F.when(ch == "x", 60).when(ch.isin("<", ">"), 50).when(ch == "d", 40).when(ch == "n", 35).when(ch.isin("S", "s"), 20 + chars.priority(ch)).when(ch == "p", 10).otherwise(0)


def batch_best(cells: DataFrame) -> DataFrame:
    """Of a batch's cells, the highest for each pair; the first tracker wins ties."""
    return cells.groupBy("src", "dst").agg(F.max_by("ch", F.struct(batch_rank(F.col("ch")), F.col("ch"))).alias("best"))


def consolidate(cells: DataFrame, best: DataFrame) -> DataFrame:
    """Every cell raised to the batch's best for its pair."""
    raised = batch_rank(F.col("best")) > batch_rank(F.col("ch"))
    return cells.join(best, ["src", "dst"], "left").select("tracker", "src", "dst", F.when(raised, F.col("best")).otherwise(F.col("ch")).alias("ch"), F.coalesce(raised, F.lit(False)).alias("changed"))


def with_reciprocals(edges: DataFrame) -> DataFrame:
    """Suggestions and what they imply for the opposite pair."""
    back = edges.select(*(c for c in edges.columns if c not in ("src", "dst", "ch")), F.col("dst").alias("src"), F.col("src").alias("dst"), chars.reciprocal(F.col("ch")).alias("ch")).where("ch IS NOT NULL")
    return edges.unionByName(back).distinct()


def apply_reciprocals(cells: DataFrame, force: bool = False) -> DataFrame:
    """Cells after each directed cell has told its opposite: forced, or where it is not lower. Never promotes to x."""
    told = cells.select("tracker", F.col("dst").alias("src"), F.col("src").alias("dst"), chars.reciprocal(F.col("ch")).alias("told")).where("told IS NOT NULL")
    joined = cells.join(told, ["tracker", "src", "dst"], "left")
    now, new = chars.priority(F.col("ch")), chars.priority(F.col("told"))
    take = F.col("told").isNotNull() & (F.lit(force) | ((new >= now) & (F.col("ch") != "n")) & (F.col("ch") != "x"))
    return joined.select("tracker", "src", "dst", F.when(take, F.col("told")).otherwise(F.col("ch")).alias("ch"))


def apply_suggestions(cells: DataFrame, suggested: DataFrame, force: bool = False) -> DataFrame:
    """cells (tracker, src, dst, ch) with suggestions (same columns): an empty cell takes any, others a higher one.

    Suggesting ``>`` where the opposite cell holds ``<`` (and the other way round) makes both cells mutual.
    """
    s = suggested.select("tracker", "src", "dst", F.col("ch").alias("new"))
    opposite = cells.select("tracker", F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("ch").alias("back"))
    told = suggested.select("tracker", F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("ch").alias("told"))
    j = cells.join(s, ["tracker", "src", "dst"], "full_outer").join(opposite, ["tracker", "src", "dst"], "left").join(told, ["tracker", "src", "dst"], "left")
    opposed = lambda a, b: ((F.col(a) == ">") & (F.col(b) == "<")) | ((F.col(a) == "<") & (F.col(b) == ">"))
    mutual = F.coalesce(opposed("new", "back"), F.lit(False)) | F.coalesce(opposed("told", "ch"), F.lit(False))
    now = F.coalesce("ch", F.lit("p"))
    take = F.col("new").isNotNull() & (F.lit(force) | now.isin("p", ".") | (chars.priority(F.col("new")) > chars.priority(now)))
    return j.select("tracker", "src", "dst", F.when(mutual, "x").when(take, F.col("new")).otherwise(now).alias("ch"))


def override(cells: DataFrame, verified: DataFrame) -> DataFrame:
    """Verified structural edges replace what is not above them; ``n`` is always replaced."""
    v = verified.select("src", "dst", F.col("ch").alias("ast"))
    take = F.col("ast").isNotNull() & ((chars.priority(F.col("ast")) >= chars.priority(F.col("ch"))) | (F.col("ch") == "n"))
    return cells.join(v, ["src", "dst"], "left").select("tracker", "src", "dst", F.when(take, F.col("ast")).otherwise(F.col("ch")).alias("ch"))


def overlay(semantic: DataFrame, structural: DataFrame) -> DataFrame:
    """Semantic suggestions take the structural character of their pair; structural pairs that are missing join them."""
    a, b = semantic.select("src", "dst", F.col("ch").alias("sem")), structural.select("src", "dst", F.col("ch").alias("ast"))
    origin = F.when(F.col("sem").isNull(), "structural").when(F.col("ast").isNull(), "semantic").otherwise("both")
    return a.join(b, ["src", "dst"], "full_outer").select("src", "dst", F.coalesce("ast", "sem").alias("ch"), origin.alias("origin"))


def merge_trackers(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """The primary's character unless it is a placeholder, else the secondary's, else p."""
    a, b = primary.select("src", "dst", F.col("ch").alias("a")), secondary.select("src", "dst", F.col("ch").alias("b"))
    return a.join(b, ["src", "dst"], "full_outer").select("src", "dst", F.coalesce(F.nullif("a", F.lit("p")), F.nullif("b", F.lit("p")), F.lit("p")).alias("ch"))


def remove_path(cells: DataFrame, gone: DataFrame) -> DataFrame:
    """Cells without the rows and columns of the removed nodes."""
    g = gone.select(F.col("node").alias("g"))
    return cells.join(g, cells["src"] == g["g"], "left_anti").join(g, cells["dst"] == g["g"], "left_anti")


def eligible_trackers(cells: DataFrame, requests: DataFrame) -> DataFrame:
    """request, src, dst -> request, tracker: trackers that know the source and at least one target."""
    known = cells.select("tracker", F.col("src").alias("node")).unionByName(cells.select("tracker", F.col("dst").alias("node"))).distinct()
    has_src = requests.select("request", F.col("src").alias("node")).distinct().join(known, "node").select("request", "tracker")
    has_dst = requests.select("request", F.col("dst").alias("node")).distinct().join(known, "node").select("request", "tracker").distinct()
    return has_src.distinct().join(has_dst, ["request", "tracker"], "left_semi")


def members(cells: DataFrame, internal: DataFrame, pins: DataFrame, suggestions: DataFrame) -> DataFrame:
    """tracker, node, why: what a module's tracker keeps: its own, pinned, on a live edge, or suggested strongly enough."""
    live = cells.where(~F.col("ch").isin("p", "o", ".", "n"))
    own = internal.select("tracker", "node", F.lit(1).alias("rank"))
    i = internal.select("tracker", F.col("node").alias("inner"))
    touching = lambda e: e.join(i, (e["tracker"] == i["tracker"]) & (e["src"] == i["inner"]), "left_semi").select("tracker", F.col("dst").alias("node")).unionByName(e.join(i, (e["tracker"] == i["tracker"]) & (e["dst"] == i["inner"]), "left_semi").select("tracker", F.col("src").alias("node")))
    strong = suggestions.where((chars.priority(F.col("ch")) >= 2) & (F.col("ch") != "n"))
    every = own.unionByName(pins.select("tracker", "node", F.lit(2).alias("rank"))).unionByName(touching(live).withColumn("rank", F.lit(3))).unionByName(touching(strong).withColumn("rank", F.lit(4)))
    why = F.element_at(F.array(*map(F.lit, ("internal", "pinned", "established", "suggested"))), F.min("rank"))
    return every.groupBy("tracker", "node").agg(why.alias("why"))
