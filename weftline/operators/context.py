"""Context packages: what fits a token budget, nearest and smallest first."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import chars


def package(links: DataFrame, tokens: DataFrame, referenced: DataFrame, budget: int) -> DataFrame:
    """links (target, dst, ch), tokens (node, full_tokens), referenced (dst) -> target, dst, tier, used, kind.

    Targets are taken without a check. Their dependencies follow by tier, then by
    size, only if some symbol of theirs is referred to; the first that overflows the
    budget ends the package.
    """
    t = tokens.select("node", F.coalesce("full_tokens", F.lit(0)).alias("size"))
    own = links.select("target").distinct().join(t, F.col("target") == F.col("node"), "left").select("target", F.coalesce("size", F.lit(0)).alias("own_size"))
    deps = links.withColumn("tier", chars.tier(F.col("ch"))).where("tier IS NOT NULL").groupBy("target", "dst").agg(F.min("tier").alias("tier"))
    eligible = deps.join(referenced.select(F.col("dst").alias("r")).distinct(), F.col("dst") == F.col("r"), "left_semi").join(t, F.col("dst") == F.col("node")).join(own, "target")
    run = Window.partitionBy("target").orderBy("tier", "size", "dst").rowsBetween(Window.unboundedPreceding, 0)
    used = eligible.withColumn("used", F.sum("size").over(run) + F.col("own_size"))
    over = used.withColumn("over", F.max(F.when(F.col("used") > budget, 1).otherwise(0)).over(run))
    return over.where("over = 0").select("target", "dst", "tier", "size", "used")
