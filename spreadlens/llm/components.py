"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def _toward_minimum(pairs: DataFrame, keep) -> DataFrame:
    """For every u: link the neighbours chosen by ``keep(u, v)`` to the least of u and its neighbours. The minimum is
    combined map-side and joined back, so a node with many neighbours never becomes one row."""
    least = pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return pairs.join(least, "u").select("u", "v", "m").where(keep).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) of every node that has an edge; root is the least node of its component. Each step is written to
    the scratch folder; the loop ends when a step changes nothing."""
    e = stage(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "cc")
    seen = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _toward_minimum(both, F.col("v") > F.col("u")).distinct()
        # small-star: u > v by construction; u itself is linked to the minimum as well
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), "m"), F.struct("u", "m"))).alias("x"))
        e = stage(small.select(F.col("x.u").alias("u"), F.col("x.m").alias("v")).where("u <> v").distinct(), "cc")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
