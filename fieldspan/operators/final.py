"""Choosing a configuration once, scoring the test set after that, and reporting on intervals."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .metrics import calc_metrics
from .selection import config_signature, one_se, seed_noise_floor
from .smearing import smearing_factor


def seeds(wanted: int | Sequence[int], first: int = 42) -> list[int]:
    """So many seeds from `first` on, or those given, which are to differ."""
    out = list(range(first, first + wanted)) if isinstance(wanted, int) else [int(s) for s in wanted]
    if not out or len(set(out)) < len(out):
        raise ValueError("seeds are to be given, and to differ")
    return out


def select_config(by_config: DataFrame, units: DataFrame, metric: str = "val_ccc", complexity: str = "n_params", config_id=None) -> dict:
    """The configuration to fit at last: the one given, or the least complex within one standard error, or the best.

    Returns config_id, rule, and doubtful: whether its lead over the next one is below what seeds alone make of it.
    """
    mean = f"{metric}_mean"
    ranked = by_config.where(F.col(mean).isNotNull()).orderBy(F.desc(mean), "config_id").select("config_id", F.col(mean).alias("m")).limit(2).collect()
    if not ranked:
        raise ValueError("no configuration has a result")
    if config_id is not None:
        if not by_config.where(F.col("config_id") == config_id).limit(1).count():
            raise ValueError(f"no such configuration: {config_id!r}")
        rule = "manual"
    else:
        se = by_config.orderBy(F.desc_nulls_last(mean), "config_id").select(f"{metric}_se").first()[0]
        found = one_se(by_config, metric, complexity).first() if se is not None and se == se else None
        rule, config_id = ("one_se", found["config_id"]) if found else ("rank1", ranked[0]["config_id"])
    noise = seed_noise_floor(units.where("status = 'success'"), metric).first()["median_sd"]
    gap = ranked[0]["m"] - ranked[1]["m"] if len(ranked) > 1 else None
    return {"config_id": config_id, "rule": rule, "doubtful": bool(noise is not None and gap is not None and gap < noise)}


def _file(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def frozen(spark: SparkSession, path: str) -> dict | None:
    """The record of a choice, or None."""
    fs, p = _file(spark, path)
    return json.loads(spark.read.text(path, wholetext=True).first()["value"]) if fs.exists(p) else None


def freeze(spark: SparkSession, path: str, config_id, rule: str = "one_se", metric: str = "val_ccc", note: str | None = None) -> dict:
    """Record a choice once. The same choice may be recorded again and changes nothing; another one is refused."""
    old = frozen(spark, path)
    if old is not None:
        if old["config_id"] != config_id:
            raise ValueError(f"{old['config_id']!r} was chosen already")
        return old
    record = {"config_id": config_id, "rule": rule, "metric": metric, "note": note}
    fs, p = _file(spark, path)
    stream = fs.create(p, False)
    stream.write(bytearray(json.dumps(record, sort_keys=True).encode()))
    stream.close()
    return record


def score_test(preds: DataFrame, record: dict | None, metric: str = "ccc", allow_unfrozen: bool = False) -> DataFrame:
    """Test metrics of each configuration, the rank of each, and which was chosen. Refused before the choice is recorded."""
    if record is None and not allow_unfrozen:
        raise ValueError("the test set may be scored after the choice only")
    chosen = record["config_id"] if record else None
    by_unit = calc_metrics(preds.where("dataset_role = 'test'"), ["config_id", "fold", "seed"])
    by = by_unit.groupBy("config_id").agg(F.count("*").alias("n_units"), F.avg(metric).alias("test_mean"), F.stddev_samp(metric).alias("test_sd"))
    # One row a configuration: few.
    rank = F.row_number().over(Window.orderBy(F.desc_nulls_last("test_mean"), "config_id"))
    return by.withColumn("test_rank", rank).withColumn("chosen", F.col("config_id") == F.lit(chosen) if chosen is not None else F.lit(False))


def level_fifths(df: DataFrame, pred: str = "pred", bins: int = 5) -> DataFrame:
    """df with `level`: which fifth of the predictions a row is in, [a, b), the last one closed; equal edges count once."""
    edges = df.agg(F.array_distinct(F.percentile(pred, F.array(*[F.lit(i / bins) for i in range(bins + 1)]))).alias("_e"))
    x = df.crossJoin(F.broadcast(edges))
    at = F.size(F.filter("_e", lambda v: v <= F.col(pred)))
    return x.withColumn("level", F.least(F.greatest(at, F.lit(1)), F.greatest(F.size("_e") - 1, F.lit(1))).cast("int")).drop("_e")


def interval_summary(rows: DataFrame, keys: Sequence[str] = ("method",)) -> DataFrame:
    """One row an interval from coverage rows (keys, stratum_type, stratum, n, coverage, mean_width): overall, by group, inside and outside the
    area of applicability, and the worst fifth."""
    pick = lambda kind, name, c: F.max(F.when((F.col("stratum_type") == kind) & (F.col("stratum") == name), F.col(c)))
    return rows.groupBy(*keys).agg(
        pick("all", "points", "n").alias("n_test"), pick("all", "points", "coverage").alias("coverage"), pick("all", "groups", "coverage").alias("coverage_by_group"),
        pick("aoa", "inside", "coverage").alias("coverage_inside_aoa"), pick("aoa", "outside", "coverage").alias("coverage_outside_aoa"),
        F.min(F.when(F.col("stratum_type") == "level", F.col("coverage"))).alias("worst_level_fifth"), pick("all", "points", "mean_width").alias("mean_width"),
    )


def worst_first(rows: DataFrame, n: int = 10) -> DataFrame:
    """The n strata of least coverage: the report's feature, so a limit."""
    return rows.orderBy(F.col("coverage").asc_nulls_last(), "stratum_type", "stratum").limit(n)


def stratum_coverage(df: DataFrame, group: str, keys: Sequence[str] = (), inside: str | None = None) -> DataFrame:
    """Coverage rows for interval_summary, of a table with obs, pred, lower and upper: points, groups, fifths of the prediction, inside or outside."""
    x = level_fifths(df.where("obs is not null and lower is not null and upper is not null"))
    x = x.select(*keys, group, "level", *([inside] if inside else []), F.col("obs").between(F.col("lower"), F.col("upper")).cast("double").alias("_in"), (F.col("upper") - F.col("lower")).alias("_w"))
    some = [F.count("*").alias("n"), F.avg("_in").alias("coverage"), F.avg("_w").alias("mean_width")]
    named = lambda d, kind, name: d.select(*keys, F.lit(kind).alias("stratum_type"), name.alias("stratum"), "n", "coverage", "mean_width")
    out = named(x.groupBy(*keys).agg(*some), "all", F.lit("points"))
    by = x.groupBy(*keys, group).agg(F.avg("_in").alias("_in"), F.avg("_w").alias("_w"))
    out = out.unionByName(named(by.groupBy(*keys).agg(*some), "all", F.lit("groups")))
    out = out.unionByName(named(x.groupBy(*keys, "level").agg(*some), "level", F.col("level").cast("string")))
    if inside:
        out = out.unionByName(named(x.groupBy(*keys, inside).agg(*some), "aoa", F.when(F.col(inside), "inside").otherwise("outside")))
    return out


def smearing_from_run(preds: DataFrame, config_id, role: str = "validation") -> DataFrame:
    """The smearing factor of a configuration's predictions in transform space, the median over seeds of each sample."""
    x = preds.where((F.col("config_id") == config_id) & (F.col("dataset_role") == role))
    return smearing_factor(x.groupBy("sample_id").agg(F.min("obs_transform").alias("obs_t"), F.median("pred_transform").alias("pred_t")))


def residuals_of_config(preds: DataFrame, units: DataFrame, config: DataFrame, params: Sequence[str]) -> DataFrame:
    """Out-of-fold predictions of the configuration with these hyperparameters, whatever its id was in that run; refused if there is none."""
    ids = config_signature(units.select("config_id", *params).distinct(), list(params))
    want = config_signature(config.select(*params), list(params)).select("signature")
    ids = ids.join(F.broadcast(want.limit(1)), "signature", "left_semi").select("config_id").distinct()
    if not ids.limit(1).count():
        raise ValueError("the run has no configuration with these hyperparameters")
    x = preds.where("dataset_role = 'validation'").join(ids, "config_id", "left_semi")
    return x.groupBy("sample_id").agg(F.min("obs").alias("obs"), F.median("pred").alias("pred"), F.count("*").alias("n_seeds"))


def share_better(df: DataFrame, against: str, block: str | None = None) -> DataFrame:
    """By metric, the share of points (or of blocks, on their mean error) where pred errs less than another column."""
    e = lambda c, power: F.pow(F.abs(F.col(c) - F.col("obs")), power)
    x = df.select(*([block] if block else []), *[(e("pred", p) - e(against, p)).alias(m) for m, p in (("mae", 1), ("rmse", 2))])
    if block:
        x = x.groupBy(block).agg(F.avg("mae").alias("mae"), F.avg("rmse").alias("rmse"))
    one = x.agg(*[F.avg((F.col(m) < 0).cast("double")).alias(m) for m in ("mae", "rmse")])
    return one.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("share_better")) for m in ("mae", "rmse")])).alias("z")).select("z.*")


def loader_loss(batches: DataFrame, loss: str = "loss", size: str = "n") -> DataFrame:
    """Mean loss of batches, weighted by their sizes."""
    return batches.agg((F.sum(F.col(loss) * F.col(size)) / F.sum(size)).alias("loss"), F.sum(size).alias("n"))


def unit_table(records: DataFrame) -> DataFrame:
    """By unit: rows done, seconds and rows a second, of records (unit_id, n, seconds)."""
    return records.groupBy("unit_id").agg(F.sum("n").alias("n"), F.sum("seconds").alias("seconds")).withColumn("per_second", F.col("n") / F.nullif("seconds", F.lit(0.0)))


def rf_grid(length: int, n_features: int | None = None) -> list[dict]:
    """Forests to try: shares of the features and node sizes, the usual ones first; with n_features, no two that come to the same."""
    # The order in which shares and node sizes are tried.
    shares, nodes = (1 / 3, 0.10, 0.50, 0.05, 0.75, 0.20, 1.00), (5, 20, 1, 10)
    pairs = sorted(((i + j, j, i) for i in range(len(shares)) for j in range(len(nodes))))[: max(1, length)]
    out, seen = [], set()
    for _, j, i in pairs:
        row = {"mtry_frac": shares[i], "min_node_size": nodes[j], "n_trees": 500}
        if n_features is not None:
            row["mtry"] = max(1, round(shares[i] * n_features))
            if (row["mtry"], nodes[j]) in seen:
                continue
            seen.add((row["mtry"], nodes[j]))
        out.append(row)
    return [{"config_id": f"rf_{n + 1:03d}"} | r for n, r in enumerate(out)]
