"""Comparing and choosing configurations."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def summarise_resamples(units: DataFrame, metrics: list[str], by: str = "config_id") -> DataFrame:
    """Units, folds, seeds, mean and sd of each metric of the successes; se of the first; failures; rank by the first."""
    ok = units.where("status = 'success'").groupBy(by).agg(
        F.count("*").alias("n_units"), F.count_distinct("fold").alias("n_folds"), F.count_distinct("seed").alias("n_seeds"),
        *[f(m).alias(f"{m}_{s}") for m in metrics for s, f in (("mean", F.avg), ("sd", F.stddev_samp))],
    )
    failed = units.where("status <> 'success'").groupBy(by).agg(F.count("*").alias("n_failed"))
    first = metrics[0]
    better = F.desc if any(x in first for x in ("ccc", "r2", "nse", "rpd", "mqi")) else F.asc
    out = ok.join(failed, by, "left").withColumn("n_failed", F.coalesce("n_failed", F.lit(0).cast("long")))
    out = out.withColumn(f"{first}_se", F.col(f"{first}_sd") / F.sqrt("n_units"))
    return out.withColumn("rank", F.row_number().over(Window.orderBy(better(f"{first}_mean"), by)))


def seed_noise_floor(units: DataFrame, metric: str) -> DataFrame:
    """Median sd and largest range over seeds, of (config, fold) with more than one seed."""
    g = units.where(F.col(metric).isNotNull()).groupBy("config_id", "fold").agg(
        F.count_distinct("seed").alias("s"), F.stddev_samp(metric).alias("sd"), (F.max(metric) - F.min(metric)).alias("range")
    )
    return g.where("s > 1").agg(F.count("*").alias("n_groups"), F.median("sd").alias("median_sd"), F.max("range").alias("max_range"))


def one_se(by_config: DataFrame, metric: str, complexity: str, maximise: bool = True) -> DataFrame:
    """The least complex configuration within one standard error of the best."""
    mean, se = f"{metric}_mean", f"{metric}_se"
    sign = 1 if maximise else -1
    best = by_config.orderBy(F.desc(F.col(mean) * sign), "config_id").limit(1).select(F.col(mean).alias("best_mean"), F.col(se).alias("best_se"))
    band = F.col("best_mean") * sign - F.col("best_se")
    near = by_config.crossJoin(F.broadcast(best)).where((F.col(mean) * sign >= band) & F.col(complexity).isNotNull())
    return near.withColumn("n_eligible", F.count("*").over(Window.partitionBy())).orderBy(complexity, "config_id").limit(1).select(
        "config_id", mean, complexity, "best_mean", "best_se", "n_eligible"
    )


def paired_test(a: DataFrame, b: DataFrame, metric: str) -> DataFrame:
    """Differences over the (fold, seed) pairs of two families: n, mean, sd, se and t."""
    x = a.select("fold", "seed", F.col(metric).alias("va")).join(b.select("fold", "seed", F.col(metric).alias("vb")), ["fold", "seed"])
    d = F.col("va") - F.col("vb")
    out = x.agg(F.count("*").alias("n_pairs"), F.avg(d).alias("mean_diff"), F.stddev_samp(d).alias("sd_diff"), F.var_samp("va").alias("_a"), F.var_samp("vb").alias("_b"))
    out = out.withColumn("se", F.col("sd_diff") / F.sqrt("n_pairs")).withColumn("unpaired_se", F.sqrt((F.col("_a") + F.col("_b")) / F.col("n_pairs")))
    return out.withColumn("t", F.col("mean_diff") / F.col("se")).drop("_a", "_b")


def t_interval(mean: float, se: float, df: int, conf: float = 0.95) -> tuple[float, float, float]:
    """Confidence limits of a mean and the two-sided p of its being 0, by Student's t."""
    def tail(t: float) -> float:
        # Integral of the density, by Simpson's rule after t = tan(x) * sqrt(df).
        c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi)
        a, b, n = math.atan(t / math.sqrt(df)), math.pi / 2, 2000
        f = lambda x: max(math.cos(x), 0) ** (df - 1)
        h = (b - a) / n
        return c * h / 3 * (f(a) + f(b) + sum((4 if i % 2 else 2) * f(a + i * h) for i in range(1, n)))

    low, high = 0.0, 1e4
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if tail(mid) > (1 - conf) / 2 else (low, mid)
    return mean - low * se, mean + low * se, 2 * tail(abs(mean / se)) if se else 0.0


def paired_interval(a: DataFrame, b: DataFrame, metric: str, conf: float = 0.95) -> DataFrame:
    """paired_test with confidence limits of the mean difference and the p of its being 0. Needs three pairs, each once.

    Units are few (one a configuration, fold and seed); only the row of sums comes to the driver.
    """
    for name, family in (("first", a), ("second", b)):
        if family.groupBy("fold", "seed").count().where("count > 1").limit(1).count():
            raise ValueError(f"the {name} family has a fold and seed more than once: choose one configuration")
    r = paired_test(a, b, metric).first()
    if r["n_pairs"] < 3:
        raise ValueError(f"{r['n_pairs']} pairs: at least three are needed")
    low, high, p = t_interval(r["mean_diff"], r["se"], r["n_pairs"] - 1, conf)
    return a.sparkSession.createDataFrame([(r["n_pairs"], r["mean_diff"], r["se"], low, high, p)], "n_pairs long, mean_diff double, se double, lower double, upper double, p double")


def rank_comparison(units: DataFrame) -> DataFrame:
    """Units by val_ccc descending, then val_mae; the rank counts successes only."""
    order = Window.orderBy(F.col("val_ccc").desc_nulls_last(), F.col("val_mae").asc_nulls_last(), "unit_id")
    ok = (F.col("status") == "success").cast("int")
    return units.withColumn("rank", F.when(ok == 1, F.sum(ok).over(order)))


def config_signature(units: DataFrame, params: list[str]) -> DataFrame:
    """name=value of each parameter, in the order of names: what a configuration is, whatever its id."""
    return units.withColumn("signature", F.concat_ws(";", *[F.concat(F.lit(f"{p}="), F.coalesce(F.col(p).cast("string"), F.lit("NA"))) for p in sorted(params)]))


def cv_residuals(preds: DataFrame) -> DataFrame:
    """Out-of-fold predictions of each sample: the median over seeds."""
    return preds.groupBy("sample_id").agg(F.min("obs").alias("obs"), F.median("pred").alias("pred"), F.count("*").alias("n_seeds"))


def early_stopping_bias(history: DataFrame, plateau: int = 20) -> DataFrame:
    """Mean loss around each run's best epoch, less the best loss. history: run, epoch, loss."""
    h = max(1, plateau // 2)
    around = Window.partitionBy("run").orderBy("epoch").rowsBetween(-h, h)
    first = Window.partitionBy("run").orderBy("loss", "epoch")
    x = history.withColumn("plateau_mean", F.avg("loss").over(around)).withColumn("_r", F.row_number().over(first)).where("_r = 1")
    bias = F.col("plateau_mean") - F.col("loss")
    return x.select("run", F.col("epoch").alias("best_epoch"), F.col("loss").alias("best_loss"), "plateau_mean", bias.alias("bias"))


def snapshot_diff(now: DataFrame, before: DataFrame) -> DataFrame:
    """key, old and new value of two snapshots, and whether it is new, gone, changed or the same."""
    x = now.select("key", F.col("value").alias("new_value")).join(before.select("key", F.col("value").alias("old_value")), "key", "full_outer")
    status = F.when(F.col("old_value").isNull(), "new").when(F.col("new_value").isNull(), "gone").when(F.col("old_value") == F.col("new_value"), "=").otherwise("changed")
    return x.withColumn("status", status)
