"""Reports on runs: what was promised, tried, finished and found."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .metrics import calc_metrics, coverage


def picp_report(df: DataFrame, group: str, alpha: float = 0.1) -> DataFrame:
    """Coverage overall and by group, with the gap to 1 - alpha and a verdict."""
    whole = coverage(df).select(F.lit("all").alias("level"), "n", "picp", "mean_width")
    by = coverage(df, [group]).select(F.col(group).cast("string").alias("level"), "n", "picp", "mean_width")
    x = whole.unionByName(by).withColumn("gap", F.col("picp") - (1 - alpha))
    verdict = F.when(F.abs("gap") <= 0.02, "matches").when(F.col("gap") < -0.1, "flagged").when(F.col("gap") < 0, "under").otherwise("over")
    return x.withColumn("verdict", verdict)


def selection_optimism(units: DataFrame, val: str, test: str) -> DataFrame:
    """By configuration: mean validation and test metric, their difference, and both ranks."""
    x = units.groupBy("config_id").agg(F.avg(val).alias("val_mean"), F.avg(test).alias("test_mean"))
    rank = lambda c: F.row_number().over(Window.orderBy(F.desc(c), "config_id"))
    return x.withColumn("optimism", F.col("val_mean") - F.col("test_mean")).withColumn("val_rank", rank("val_mean")).withColumn("test_rank", rank("test_mean"))


def hyper_table(grid: DataFrame, params: list[str]) -> DataFrame:
    """By hyperparameter: how many values were tried, which, and whether it was tuned."""
    z = F.explode(F.array(*[F.struct(F.lit(p).alias("parameter"), F.col(p).cast("string").alias("value")) for p in params]))
    x = grid.select(z.alias("z")).select("z.*").groupBy("parameter").agg(F.count_distinct("value").alias("n_values"), F.array_join(F.array_sort(F.collect_set("value")), ",").alias("tried"))
    return x.withColumn("tuned", F.col("n_values") > 1)


def ledger(promised: DataFrame, ran: DataFrame) -> DataFrame:
    """promised: id. ran: id, ok. The verdict of each promised check: passed, failed or missing."""
    x = promised.join(ran.groupBy("id").agg(F.min(F.col("ok").cast("int")).alias("_ok")), "id", "left")
    return x.select("id", F.when(F.col("_ok").isNull(), "missing").when(F.col("_ok") == 1, "passed").otherwise("failed").alias("verdict"))


def bias_sweep(history: DataFrame, plateaus: list[int]) -> DataFrame:
    """Early-stopping bias of all runs for several plateau widths."""
    from .selection import early_stopping_bias

    out = None
    for p in plateaus:
        part = early_stopping_bias(history, p).select("run", F.lit(p).alias("plateau"), "plateau_mean", "bias", F.lit(100.0).alias("_c"))
        out = part if out is None else out.unionByName(part)
    return out.withColumn("bias_pct", F.col("_c") * F.col("bias") / F.abs("plateau_mean")).drop("_c", "plateau_mean")


def performance_table(df: DataFrame, keys: list[str]) -> DataFrame:
    return calc_metrics(df, keys)


def dominant_variable(points: DataFrame, value_columns: list[str], size: float) -> DataFrame:
    """Cells of a map of attributions: mean of each variable, and the one of largest mean absolute value."""
    at = lambda c: F.floor(F.col(c) / size).cast("long")
    m = points.groupBy(at("x").alias("i"), at("y").alias("j")).agg(F.count("*").alias("n"), *[F.avg(F.abs(c)).alias(c) for c in value_columns])
    best = F.greatest(*[F.struct(F.col(c).alias("v"), F.lit(-k).alias("k")) for k, c in enumerate(value_columns)])
    return m.withColumn("dominant", F.get(F.array(*map(F.lit, value_columns)), -best["k"]))


def clean_name(name):
    """Lower case, runs of other characters as one underscore, none at the ends; an x before a leading digit."""
    c = F.trim(F.regexp_replace(F.lower(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1_$2")), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.when(c.rlike("^[0-9]"), F.concat(F.lit("x"), c)).otherwise(c)


def onehot_sets(names: list[str], rows: DataFrame) -> DataFrame:
    """variable, channel: 0/1 columns whose names share all but the last token and that are never 1 together form one variable."""
    stems: dict[str, list[str]] = {}
    for n in names:
        stems.setdefault(n.rsplit("_", 1)[0], []).append(n)
    many = {s: c for s, c in stems.items() if len(c) > 1}
    sums = [F.max(sum((F.col(c) for c in cols[1:]), F.col(cols[0]))).alias(f"s{i}") for i, cols in enumerate(many.values())]
    one = rows.agg(*sums, F.lit(0).alias("_"))
    pairs = F.explode(F.array(*[F.struct(F.when(F.col(f"s{list(many).index(s)}") <= 1, s).otherwise(c).alias("variable") if s in many else F.lit(c).alias("variable"), F.lit(c).alias("channel")) for s, cols in stems.items() for c in cols]))
    return one.select(pairs.alias("p")).select("p.*")


def strata_quota(counts: DataFrame, frac: float) -> DataFrame:
    """counts: stratum, n. The least common quota q whose sum of min(n, q) reaches the fraction, by sizes in rising order."""
    total = counts.agg(F.ceil(F.sum("n") * frac).alias("goal"), F.count("*").alias("m"))
    up = Window.orderBy("n", "stratum")
    x = counts.withColumn("_below", F.coalesce(F.sum("n").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_i", F.row_number().over(up)).crossJoin(F.broadcast(total))
    need = F.ceil((F.col("goal") - F.col("_below")) / (F.col("m") - F.col("_i") + 1))
    return x.where(need <= F.col("n")).agg(F.min_by(need, "_i").alias("quota"))
