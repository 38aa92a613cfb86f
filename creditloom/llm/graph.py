"""Connected components by contracting stars, every step a pair of aggregations and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.operators.sizing import settle


def _stars(edges: DataFrame, larger: bool) -> DataFrame:
    """One contraction. Larger: each node hands its larger neighbours to its least neighbour;
    else each node hands its smaller neighbours and itself over."""
    if larger:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = both.join(least, "u")
    if larger:
        out = moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = moved.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u != v")
    return out.distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges(u, v)``; the root is the least node reachable.

    Edges and nodes stay distributed; each round is written to the shared folder, so a lost
    executor costs one round at most.
    """
    now = settle(edges.where("u != v").distinct())
    mark = None
    while True:
        now = settle(_stars(_stars(now, True), False))
        got = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
        if got == mark:
            break
        mark = got
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
