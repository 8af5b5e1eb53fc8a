"""Aggregation of importances, accumulated effects and Shapley values."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def importance_aggregate(raw: DataFrame) -> DataFrame:
    """raw: model, variable, draw, drop -> mean over draws, then over models; pooled sd of draws; rank."""
    by_model = raw.groupBy("model", "variable").agg(F.avg("drop").alias("m"), F.var_samp("drop").alias("v"))
    a = by_model.groupBy("variable").agg(F.avg("m").alias("importance"), F.stddev_samp("m").alias("sd_models"), F.sqrt(F.avg("v")).alias("sd_draws"))
    return a.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("importance"), "variable")))


def importance_weights(table: DataFrame) -> DataFrame:
    """Non-negative weights of mean 1."""
    w = F.greatest(F.coalesce("importance", F.lit(0.0)), F.lit(0.0))
    return table.select("variable", (w / F.avg(w).over(Window.partitionBy())).alias("weight"))


def compare_importance(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two tables side by side: share of the largest, ranks and their mean."""
    whole = Window.partitionBy()
    x = a.select("variable", F.col("importance").alias("ia")).join(b.select("variable", F.col("importance").alias("ib")), "variable", "full_outer")
    for c in ("a", "b"):
        x = x.withColumn(f"share_{c}", F.col(f"i{c}") / F.max(f"i{c}").over(whole)).withColumn(f"rank_{c}", F.rank().over(Window.orderBy(F.col(f"i{c}").desc_nulls_last())))
    return x.withColumn("mean_rank", (F.col("rank_a") + F.col("rank_b")) / 2).drop("ia", "ib")


def rank_agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """n variables of both tables, and Spearman's correlation of their importances (ties share their mean rank)."""
    x = a.select("variable", F.col("importance").alias("ia")).join(b.select("variable", F.col("importance").alias("ib")), "variable")
    for c in ("ia", "ib"):
        x = x.withColumn(f"_{c}", F.rank().over(Window.orderBy(c)) + (F.count("*").over(Window.partitionBy(c)) - 1) / 2)
    return x.agg(F.count("*").alias("n"), F.corr("_ia", "_ib").alias("spearman"))


def ale_accumulate(d: DataFrame) -> DataFrame:
    """variable, bin, n, diff (mean local difference) -> the accumulated, centred effect at each bin's upper edge."""
    run = Window.partitionBy("variable").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = d.withColumn("acc", F.sum("diff").over(run)).withColumn("mid", F.col("acc") - F.col("diff") / 2)
    whole = Window.partitionBy("variable")
    centre = F.sum(F.col("mid") * F.col("n")).over(whole) / F.sum("n").over(whole)
    return x.select("variable", "bin", "n", (F.col("acc") - centre).alias("effect"), (F.col("mid") - centre).alias("mid_effect"))


def shapley(values: DataFrame, players: int) -> DataFrame:
    """id, mask, v: the worth of each coalition as a bit mask -> phi of each player, exactly. At most 14 players.

    Each coalition meets the one without the player by an equi-join on (id, mask).
    """
    if players > 14:
        raise ValueError("exact values take 2**players coalitions; at most 14 players")
    weight = F.lit(0.0)
    size = F.bit_count("mask")
    for s in range(players):
        weight = F.when(size == s + 1, math.factorial(s) * math.factorial(players - s - 1) / math.factorial(players)).otherwise(weight)
    with_ = values.withColumn("player", F.explode(F.sequence(F.lit(0), F.lit(players - 1)))).where(F.expr("(mask & shiftleft(1, player)) <> 0"))
    with_ = with_.select("id", "player", F.expr("mask ^ shiftleft(1, player)").alias("_m"), F.col("v").alias("_v"), weight.alias("_w"))
    j = with_.join(values.select("id", F.col("mask").alias("_m"), "v"), ["id", "_m"])
    return j.groupBy("id", "player").agg(F.sum(F.col("_w") * (F.col("_v") - F.col("v"))).alias("phi"))
