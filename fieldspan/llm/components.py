"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._work import keep

ROUNDS = 40


def components(edges: DataFrame) -> DataFrame:
    """(u, v) pairs of longs -> (node, root): the smallest node that each node is linked to.

    Large and small stars in turn, each a minimum by node (combined before the shuffle) and a join of two
    written tables, which Spark splits when one node has most of the edges. The number of rounds grows
    with the logarithm of the longest chain. Nodes without edges have no row; nulls are to be left out.
    """
    now = keep(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for _ in range(ROUNDS):
        # Large star: neighbours above a node go to the smallest one of its neighbours and itself.
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = keep(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "stars")
        big = keep(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "edges")
        # Small star: neighbours below a node, and itself, go to the smallest of them.
        low = keep(big.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "stars")
        small = big.join(low.select("u", "m"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = keep(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        stars = after.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").limit(1).count() == 0
        chained = not stars or after.select(F.col("v").alias("u")).join(after.select("u"), "u", "left_semi").limit(1).count() > 0
        now = after
        if not chained:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
