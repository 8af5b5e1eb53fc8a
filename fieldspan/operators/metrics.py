"""Accuracy of predictions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import finite, only_finite, ratio


def calc_metrics(df: DataFrame, by: list[str] = (), obs: str = "obs", pred: str = "pred") -> DataFrame:
    """n, ccc, r2, mae, nse, rmse, rpd, mqi, bias and bias_pct of finite pairs by group; null where undefined."""
    o, p = F.col(obs), F.col(pred)
    a = only_finite(df, obs, pred).groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(o).alias("mo"), F.avg(p).alias("mp"), F.var_pop(o).alias("vo"), F.var_pop(p).alias("vp"),
        F.covar_pop(o, p).alias("c"), F.avg(F.abs(p - o)).alias("mae_"), F.avg((p - o) * (p - o)).alias("mse"), F.avg(p - o).alias("bias_"), F.stddev_samp(o).alias("so"),
    )
    return _from_moments(a, by)


def _from_moments(a: DataFrame, by: list[str]) -> DataFrame:
    many = F.col("n") >= 2
    get = lambda x: F.when(many, x)
    ccc = get(ratio(2 * F.col("c"), F.col("vo") + F.col("vp") + F.pow(F.col("mo") - F.col("mp"), 2)))
    r2 = get(ratio(F.col("c") * F.col("c"), F.col("vo") * F.col("vp")))
    nse = get(1 - ratio(F.col("mse"), F.col("vo")))
    mae, rmse, bias = get(F.col("mae_")), get(F.sqrt("mse")), get(F.col("bias_"))
    return a.select(
        *by, "n", ccc.alias("ccc"), r2.alias("r2"), mae.alias("mae"), nse.alias("nse"), rmse.alias("rmse"), ratio(F.col("so"), rmse).alias("rpd"),
        ratio(ccc * nse * F.when(F.col("mo") != 0, F.col("mo")), mae).alias("mqi"), bias.alias("bias"), ratio(100 * bias, F.col("mo")).alias("bias_pct"),
    )


class Moments:
    """What calc_metrics needs of the finite pairs of each key, added up batch by batch in a task."""

    FIELDS = "n long, mo double, mp double, so double, sp double, sop double, ae double, se double"

    def __init__(self):
        self.of: dict[tuple, np.ndarray] = {}

    def add(self, key: tuple, obs: np.ndarray, pred: np.ndarray) -> None:
        ok = np.isfinite(obs) & np.isfinite(pred)
        o, p = (obs, pred) if ok.all() else (obs[ok], pred[ok])
        if not len(o):
            return
        mo, mp, e = o.mean(), p.mean(), p - o
        do, dp = o - mo, p - mp
        new = np.array([len(o), mo, mp, do @ do, dp @ dp, do @ dp, np.abs(e).sum(), e @ e])
        old = self.of.get(key)
        if old is not None:
            n, (a, b) = old[0] + new[0], new[1:3] - old[1:3]
            w = old[0] * new[0] / n
            new = np.array([n, *(old[1:3] + np.array([a, b]) * new[0] / n), *(old[3:] + new[3:] + np.array([a * a * w, b * b * w, a * b * w, 0, 0]))])
        self.of[key] = new

    def frame(self, names: list[str]) -> pd.DataFrame:
        fields = [f.split()[0] for f in self.FIELDS.split(", ")]
        return pd.DataFrame([[*k, *v] for k, v in self.of.items()], columns=[*names, *fields]).astype({"n": "int64"})


def metrics_of_moments(parts: DataFrame, by: list[str] = ()) -> DataFrame:
    """calc_metrics of rows of Moments; a group has one row a task."""
    fields = [f.split()[0] for f in Moments.FIELDS.split(", ")]

    def merged(x: Column, y: Column) -> Column:
        n, a, b = x["n"] + y["n"], y["mo"] - x["mo"], y["mp"] - x["mp"]
        w = x["n"] * y["n"] / n
        plus = {"so": a * a * w, "sp": b * b * w, "sop": a * b * w, "ae": F.lit(0.0), "se": F.lit(0.0)}
        return F.struct(
            n.alias("n"), (x["mo"] + a * y["n"] / n).alias("mo"), (x["mp"] + b * y["n"] / n).alias("mp"), *[(x[c] + y[c] + v).alias(c) for c, v in plus.items()]
        )

    rows = parts.select(*by, F.struct(F.col("n").cast("double").alias("n"), *fields[1:]).alias("m")).groupBy(*by).agg(F.array_sort(F.collect_list("m")).alias("m"))
    m = F.aggregate(F.slice("m", F.lit(2), F.greatest(F.size("m") - 1, F.lit(0))), F.get("m", F.lit(0)), merged)
    x = rows.where(F.size("m") > 0).withColumn("m", m).select(*by, "m.*")
    n = F.col("n")
    return _from_moments(x.select(
        *by, n.cast("long").alias("n"), "mo", "mp", (F.col("so") / n).alias("vo"), (F.col("sp") / n).alias("vp"), (F.col("sop") / n).alias("c"), (F.col("ae") / n).alias("mae_"), (F.col("se") / n).alias("mse"),
        (F.col("mp") - F.col("mo")).alias("bias_"), F.when(n > 1, F.sqrt(F.col("so") / F.nullif(n - 1, F.lit(0.0)))).alias("so"),
    ), by)


def ccc_by_group(df: DataFrame, by: list[str], obs: str = "obs", pred: str = "pred") -> DataFrame:
    return calc_metrics(df, by, obs, pred).select(*by, "n", "ccc")


def quantile_performance(df: DataFrame, obs: str = "obs", pred: str = "pred") -> DataFrame:
    """Metrics by bins of the observed quantiles 25, 50, 75, 90, 95 and 99 of the whole table."""
    df = only_finite(df, obs, pred)
    from .intervals import percentiles

    edges = percentiles(df, obs, [0.25, 0.5, 0.75, 0.9, 0.95, 0.99]).withColumnRenamed("q", "e")
    names = ("Q00_Q25", "Q25_Q50", "Q50_Q75", "Q75_Q90", "Q90_Q95", "Q95_Q99")
    bin_ = F.lit("Q99_Q100")
    for i in range(5, -1, -1):
        bin_ = F.when(F.col(obs) <= F.col("e")[i], names[i]).otherwise(bin_)
    return calc_metrics(df.crossJoin(F.broadcast(edges)).withColumn("bin", bin_), ["bin"], obs, pred)


def transform_loss(df: DataFrame, by: list[str] = (), obs: str = "obs", pred: str = "pred") -> DataFrame:
    """Mean smooth L1 (beta 1), squared and absolute loss."""
    d = F.abs(F.col(pred) - F.col(obs))
    return only_finite(df, obs, pred).groupBy(*by).agg(
        F.avg(F.when(d < 1, 0.5 * d * d).otherwise(d - 0.5)).alias("smooth_l1"), F.avg(d * d).alias("mse"), F.avg(d).alias("mae")
    )


def coverage(df: DataFrame, by: list[str] = (), obs: str = "obs", lower: str = "lower", upper: str = "upper") -> DataFrame:
    """n, share of observations inside their interval, mean and median width. Infinite bounds cover."""
    ok = df.where(finite(obs) & F.col(lower).isNotNull() & F.col(upper).isNotNull())
    inside = F.col(obs).between(F.col(lower), F.col(upper)).cast("double")
    width = F.col(upper) - F.col(lower)
    return ok.groupBy(*by).agg(F.count("*").alias("n"), F.avg(inside).alias("picp"), F.avg(width).alias("mean_width"), F.median(width).alias("median_width"))


def coverage_rows(df: DataFrame, group: str, stratum: str) -> DataFrame:
    """Coverage by points, as the mean over groups, and within each stratum."""
    inside = F.col("obs").between(F.col("lower"), F.col("upper")).cast("double")
    x = df.where(finite("obs")).select(group, stratum, inside.alias("_in"))
    points = x.agg(F.lit("all").alias("stratum"), F.lit("points").alias("level"), F.count("*").alias("n"), F.avg("_in").alias("coverage"))
    groups = x.groupBy(group).agg(F.avg("_in").alias("_in")).agg(F.lit("all").alias("stratum"), F.lit("groups").alias("level"), F.count("*").alias("n"), F.avg("_in").alias("coverage"))
    strata = x.groupBy(F.col(stratum).cast("string").alias("level")).agg(F.count("*").alias("n"), F.avg("_in").alias("coverage"))
    return points.unionByName(groups).unionByName(strata.select(F.lit(stratum).alias("stratum"), "level", "n", "coverage"))
