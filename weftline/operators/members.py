"""Classes across files: bases, the order in which they are searched, and where a member comes from."""

from __future__ import annotations

import ast
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators import scopes
from weftline.operators.readers import rows_of
from weftline.operators.rounds import spool

CLASSES = "path string, class string, kind string, name string, place int"


def _dotted(node: ast.AST) -> str:
    return ast.unparse(node) if isinstance(node, (ast.Name, ast.Attribute)) else ""


def read_classes(path: str, content: str | None) -> list[tuple]:
    """(path, class, kind, name, place) with kinds class, base (in order), method, and attribute (set on self in __init__)."""
    try:
        tree = ast.parse(content or "")
    except (SyntaxError, ValueError, RecursionError):
        return []
    rows: list[tuple] = []
    pending: list[tuple[str, ast.AST]] = [("", tree)]
    while pending:
        outer, node = pending.pop()
        for c in getattr(node, "body", ()):
            if not isinstance(c, ast.ClassDef):
                continue
            name = f"{outer}{c.name}"
            pending.append((f"{name}.", c))
            rows.append((path, name, "class", name, 0))
            rows += [(path, name, "base", _dotted(b.value if isinstance(b, ast.Subscript) else b), i) for i, b in enumerate(c.bases) if _dotted(b.value if isinstance(b, ast.Subscript) else b)]
            for m in c.body:
                if isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef)):
                    rows.append((path, name, "method", m.name, m.lineno))
                    if m.name == "__init__":
                        stores = {x.attr for x in ast.walk(m) if isinstance(x, ast.Attribute) and isinstance(x.ctx, ast.Store) and isinstance(x.value, ast.Name) and x.value.id == "self"}
                        rows += [(path, name, "attribute", a, m.lineno) for a in sorted(stores)]
    return rows


def classes(files: DataFrame) -> DataFrame:
    """path, content -> CLASSES."""
    return rows_of(files.where(F.col("path").endswith(".py")), read_classes, CLASSES)


def _id(path: Column, name: Column) -> Column:
    return F.concat(path, F.lit(":"), name)


def resolved_bases(found: DataFrame, files: DataFrame, roots: Sequence[str] = ("",)) -> DataFrame:
    """id, place, base: each base as path:class where a file of the project defines it, else as it is written.

    A class of the same file comes first, then what the imported name stands for: a class in the file it leads to, or
    in the module below that it names.
    """
    bases = found.where("kind = 'base'").select("path", "class", "name", "place")
    known = found.where("kind = 'class'").select(_id(F.col("path"), F.col("class")).alias("known")).distinct()
    named = scopes.resolve_names(bases.select("path", "name"), scopes.import_scopes(scopes.imported(files), files, roots)).select(F.col("path").alias("n_path"), F.col("name").alias("n_name"), "dst", "item", "rest")
    j = bases.join(named, (F.col("path") == F.col("n_path")) & (F.col("name") == F.col("n_name")), "left")
    folder = F.regexp_replace("dst", "[^/]*$", "")
    whole = F.concat_ws(".", F.nullif("item", F.lit("")), F.nullif("rest", F.lit("")))
    tried = F.array(_id(F.col("path"), F.col("name")), _id(F.col("dst"), whole), _id(F.concat(folder, "item", F.lit(".py")), F.col("rest")), _id(F.concat(folder, "item", F.lit("/__init__.py")), F.col("rest")))
    each = j.select(_id(F.col("path"), F.col("class")).alias("id"), "place", "name", F.posexplode(tried).alias("rank", "try"))
    hit = each.join(known, F.col("try") == F.col("known"), "left").groupBy("id", "place", "name").agg(F.min_by("known", F.when(F.col("known").isNotNull(), F.col("rank"))).alias("base"))
    return hit.select("id", "place", F.coalesce("base", "name").alias("base"))


def merged(name: str, orders: list[list[str]], bases: list[str]) -> list[str] | None:
    """The class before all that its bases' orders hold, each order kept and bases in the order given; None where they disagree."""
    rest, out = [list(o) for o in orders] + [list(bases)], [name]
    while rest := [r for r in rest if r]:
        head = next((r[0] for r in rest if not any(r[0] in other[1:] for other in rest)), None)
        if head is None:
            return None
        out.append(head)
        rest = [r[1:] if r[0] == head else r for r in rest]
    return out


def orders(found: DataFrame, files: DataFrame, roots: Sequence[str] = ("",)) -> DataFrame:
    """path, class, mro, status: ids of the classes that are searched for a class's members, itself first.

    Classes get their order once all their bases have one, a level of inheritance a round. Status is ``ok``;
    ``conflict`` where the bases' orders disagree, and below such a class; ``cycle`` for classes that inherit from
    themselves by whatever way, and below those. Neither of these two has an order but itself. Bases outside the project
    are leaves.
    """
    own = found.where("kind = 'class'").select("path", "class").distinct().withColumn("id", _id(F.col("path"), F.col("class")))
    bases = resolved_bases(found, files, roots)
    lists = bases.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("place", "base"))).alias("b")).select(F.col("id").alias("b_id"), F.transform("b", lambda x: x["base"]).alias("bases"))
    pending = spool(own.join(lists, F.col("id") == F.col("b_id"), "left").select("path", "class", "id", F.coalesce("bases", F.array().cast("array<string>")).alias("bases")), "classes")
    join = F.udf(lambda name, o, b: merged(name, o, b), "array<string>")
    done: DataFrame | None = None
    while True:
        inside = pending.select(F.col("id").alias("open"))
        wanted = pending.select("id", F.explode("bases").alias("base"))
        waits = wanted.join(inside, F.col("base") == F.col("open"), "left_semi").select(F.col("id").alias("waiting")).distinct()
        ready = pending.join(waits, F.col("id") == F.col("waiting"), "left_anti")
        flat = ready.select("path", "class", "id", "bases", F.posexplode_outer("bases").alias("place", "base"))
        if done is None:
            ordered = flat.withColumn("m", F.when(F.col("base").isNotNull(), F.array("base"))).withColumn("bad", F.lit(False))
        else:
            d = done.select(F.col("id").alias("d_id"), F.col("mro").alias("d_mro"), (F.col("status") != "ok").alias("d_bad"))
            ordered = flat.join(d, F.col("base") == F.col("d_id"), "left").withColumn("m", F.coalesce("d_mro", F.when(F.col("base").isNotNull(), F.array("base")))).withColumn("bad", F.coalesce("d_bad", F.lit(False)))
        one = ordered.groupBy("path", "class", "id", "bases").agg(F.array_sort(F.collect_list(F.when(F.col("m").isNotNull(), F.struct("place", "m")))).alias("ms"), F.bool_or("bad").alias("bad"))
        order = F.when(~F.col("bad"), join("id", F.transform("ms", lambda x: x["m"]), "bases"))
        step = one.select("path", "class", "id", order.alias("order")).select("path", "class", "id", F.coalesce("order", F.array("id")).alias("mro"), F.when(F.col("order").isNull(), "conflict").otherwise("ok").alias("status"))
        step = spool(step, "orders")
        if step.isEmpty():
            break
        done = step if done is None else done.unionByName(step)
        named = step.select(F.col("id").alias("now"))
        pending = spool(pending.join(named, F.col("id") == F.col("now"), "left_anti"), "classes")
    cyclic = pending.select("path", "class", "id", F.array("id").alias("mro"), F.lit("cycle").alias("status"))
    return cyclic if done is None else done.unionByName(cyclic)


def lookup(refs: DataFrame, found: DataFrame, ordered: DataFrame) -> DataFrame:
    """refs (path, class, member) -> status, owner: the first class in order that has the method or attribute.

    ``member`` with its owner; ``assumed`` where no class in order has any method; ``absent``; ``no class``.
    """
    held = found.where("kind IN ('method', 'attribute')").select(_id(F.col("path"), F.col("class")).alias("owner_id"), "kind", "name").distinct()
    r = refs.select("path", "class", "member").distinct()
    o = ordered.select(F.col("path").alias("o_path"), F.col("class").alias("o_class"), "mro")
    j = r.join(o, (F.col("path") == F.col("o_path")) & (F.col("class") == F.col("o_class")), "left")
    each = j.select("path", "class", "member", F.col("mro").isNotNull().alias("known"), F.posexplode_outer("mro").alias("rank", "at"))
    has = held.select("owner_id", F.col("name").alias("h_name")).distinct()
    full = held.where("kind = 'method'").select(F.col("owner_id").alias("full")).distinct()
    hit = each.join(has, (F.col("at") == F.col("owner_id")) & (F.col("member") == F.col("h_name")), "left").join(full, F.col("at") == F.col("full"), "left")
    g = hit.groupBy("path", "class", "member").agg(F.bool_or("known").alias("known"), F.min_by("owner_id", F.when(F.col("owner_id").isNotNull(), F.col("rank"))).alias("owner"), F.count("full").alias("n_full"))
    status = F.when(~F.col("known"), "no class").when(F.col("owner").isNotNull(), "member").when(F.col("n_full") == 0, "assumed").otherwise("absent")
    return g.select("path", "class", "member", status.alias("status"), "owner")


def inherits_from(bases: Column, mro: Column, *needles: str) -> Column:
    """Whether any needle is part of the names of bases and order, in any letter case."""
    names = F.lower(F.array_join(F.concat(F.coalesce(bases, F.array().cast("array<string>")), F.coalesce(mro, F.array().cast("array<string>"))), " "))
    out = F.lit(False)
    for n in needles:
        out = out | F.contains(names, F.lit(n.lower()))
    return out
