"""Mean surfaces from models of a transformed target."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import only_finite


def smearing_factor(df: DataFrame) -> DataFrame:
    """obs_t, pred_t -> n, mean exp(residual), its lognormal twin, and the one weighted by exp(prediction)."""
    e = F.col("obs_t") - F.col("pred_t")
    x = only_finite(df, "obs_t", "pred_t")
    return x.agg(
        F.count("*").alias("n"), F.avg(F.exp(e)).alias("s"), F.exp(F.avg(e) + F.var_samp(e) / 2).alias("s_lognormal"),
        (F.sum(F.exp("pred_t") * F.exp(e)) / F.sum(F.exp("pred_t"))).alias("s_weighted"),
    )


def smearing_levels(df: DataFrame, bins: int = 5) -> DataFrame:
    """Median prediction, mean exp(residual) and count by quantile bins of the prediction, closed on the right."""
    x = only_finite(df, "obs_t", "pred_t")
    edges = x.agg(F.percentile("pred_t", F.array(*[F.lit(i / bins) for i in range(1, bins)])).alias("e"))
    x = x.crossJoin(F.broadcast(edges)).withColumn("bin", (F.size(F.filter("e", lambda v: v < F.col("pred_t"))) + 1).cast("int"))
    return x.groupBy("bin").agg(F.median("pred_t").alias("centre"), F.avg(F.exp(F.col("obs_t") - F.col("pred_t"))).alias("s"), F.count("*").alias("n"))


def smear(df: DataFrame, factor: DataFrame, lower_limit: float = 0.0, log1p: bool = True) -> DataFrame:
    """exp(pred_t) * S, less 1 under log1p, not below lower_limit."""
    x = df.crossJoin(F.broadcast(factor.select("s")))
    return x.withColumn("mean_surface", F.greatest(F.exp("pred_t") * F.col("s") - (1 if log1p else 0), F.lit(lower_limit))).drop("s")


def smear_level(df: DataFrame, levels: DataFrame, lower_limit: float = 0.0, log1p: bool = True) -> DataFrame:
    """As smear, with S interpolated between the bins' medians, the ends held. Bins are few and travel as arrays."""
    a = levels.agg(F.sort_array(F.collect_list(F.struct("centre", "s"))).alias("l"))
    x = df.crossJoin(F.broadcast(a))
    i = F.size(F.filter("l", lambda v: v["centre"] <= F.col("pred_t")))
    lo, hi = F.get("l", i - 1), F.get("l", i)
    between = lo["s"] + (hi["s"] - lo["s"]) * (F.col("pred_t") - lo["centre"]) / F.nullif(hi["centre"] - lo["centre"], F.lit(0.0))
    s = F.when(i == 0, F.get("l", F.lit(0))["s"]).when(i == F.size("l"), F.get("l", F.size("l") - 1)["s"]).otherwise(between)
    return x.withColumn("mean_surface", F.greatest(F.exp("pred_t") * s - (1 if log1p else 0), F.lit(lower_limit))).drop("l")


def smearing_check(df: DataFrame, columns: list[str], obs: str = "obs") -> DataFrame:
    """Relative bias, mae and rmse of each surface."""
    parts = F.explode(F.array(*[F.struct(F.lit(c).alias("method"), F.col(c).cast("double").alias("p")) for c in columns]))
    x = df.select(F.col(obs).alias("o"), parts.alias("z")).select("o", "z.*")
    return x.groupBy("method").agg(
        F.count("*").alias("n"), (100 * (F.sum("p") - F.sum("o")) / F.sum("o")).alias("bias_pct"), F.avg(F.abs(F.col("p") - F.col("o"))).alias("mae"),
        F.sqrt(F.avg(F.pow(F.col("p") - F.col("o"), 2))).alias("rmse"),
    )
