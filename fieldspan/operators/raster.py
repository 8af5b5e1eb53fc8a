"""Rasters as cells (band, row, col, value), patches as arrays, features and scaling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import finite


def qc(df: DataFrame, value: str, na_below: float | None = None, clamp: tuple[float, float] | None = None) -> DataFrame:
    """value with sentinels at or below na_below as null, and finite values clamped."""
    v = F.col(value)
    if na_below is not None:
        v = F.when(~finite(v) | (v > na_below), v)
    if clamp:
        v = F.when(finite(v), F.least(F.greatest(v, F.lit(clamp[0])), F.lit(clamp[1]))).otherwise(v)
    return df.withColumn(value, v)


def predictor_types(long: DataFrame) -> DataFrame:
    """By predictor of a long table: distinct values, least, largest, is it a 0/1 dummy, and its risk."""
    a = long.groupBy("predictor").agg(F.count_distinct("value").alias("n_unique"), F.min("value").alias("min"), F.max("value").alias("max"), F.count_if(~F.col("value").isin(0.0, 1.0)).alias("_o"), F.count_if(F.col("value").isNull()).alias("n_na"))
    dummy = (F.col("n_unique") <= 2) & (F.col("_o") == 0)
    risk = F.when(F.col("n_unique") <= 1, "constant").when((F.col("n_unique") <= 2) & ~dummy, "near_constant").when(F.col("n_na") > 0, "has_na").otherwise("ok")
    return a.withColumn("is_dummy", dummy).withColumn("risk", risk).drop("_o")


def fit_scaling(long: DataFrame, types: DataFrame) -> DataFrame:
    """Centre and scale of each (fold, predictor) from its training rows: 0 and 1 for a dummy, else mean and sample sd."""
    a = long.groupBy("fold", "predictor").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s")).join(F.broadcast(types.select("predictor", "is_dummy")), "predictor")
    bad = ~F.col("is_dummy") & (F.col("s").isNull() | (F.col("s") == 0))
    scale = F.when(F.col("is_dummy") | bad, 1.0).otherwise(F.col("s"))
    return a.select("fold", "predictor", F.when(F.col("is_dummy"), 0.0).otherwise(F.col("m")).alias("center"), scale.alias("scale"), bad.alias("degenerate"))


def scale(long: DataFrame, scaling: DataFrame) -> DataFrame:
    return long.join(F.broadcast(scaling), ["fold", "predictor"]).withColumn("scaled", (F.col("value") - F.col("center")) / F.col("scale"))


def patches(cells: DataFrame, points: DataFrame, window: int) -> DataFrame:
    """(sample_id, band, patch, valid) of points (sample_id, row, col): the cells around each, row offset fastest.

    Patches are cut once for each distinct centre, by an equi-join of its offsets with cells, and points meet them by row and
    col: a point is shuffled once, however large the window. Points of one sample_id share a patch. Valid where all cells
    exist and are finite.
    """
    h = window // 2
    offsets = F.explode(F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc"), F.lit((dc + h) * window + dr + h).alias("pos")) for dc in range(-h, h + 1) for dr in range(-h, h + 1)]))
    centres = points.select(F.col("row").alias("_r"), F.col("col").alias("_c")).where("_r is not null and _c is not null").distinct().withColumn("o", offsets)
    centres = centres.select("_r", "_c", (F.col("_r") + F.col("o.dr")).alias("row"), (F.col("_c") + F.col("o.dc")).alias("col"), F.col("o.pos").alias("pos"))
    # Merged: sizes are guessed without the explosion, and a broadcast by such a guess would fill the driver.
    g = centres.hint("merge").join(cells, ["row", "col"]).groupBy("_r", "_c", "band").agg(F.sort_array(F.collect_list(F.struct("pos", "value"))).alias("z"), F.count_if(finite("value")).alias("n"))
    g = g.withColumnsRenamed({"_r": "row", "_c": "col"})
    ids = points.groupBy("sample_id").agg(F.count("*").alias("_k"), F.min("row").alias("row"), F.min("col").alias("col"))
    whole = lambda z, n: (F.transform(z, lambda s: s["value"]).alias("patch"), (n == window * window).alias("valid"))
    one = ids.where("_k = 1").hint("merge").join(g, ["row", "col"]).select("sample_id", "band", *whole("z", F.col("n")))
    often = ids.where("_k > 1").select(F.col("sample_id").alias("_id"))
    often = points.select("sample_id", "row", "col").hint("merge").join(often, F.col("sample_id").eqNullSafe(F.col("_id")), "left_semi").hint("merge").join(g, ["row", "col"])
    often = often.groupBy("sample_id", "band").agg(F.sort_array(F.flatten(F.collect_list("z"))).alias("z"), F.sum("n").alias("n"))
    return one.unionByName(often.select("sample_id", "band", *whole("z", F.col("n"))))


def patch_blame(p: DataFrame) -> DataFrame:
    """By band: points it invalidates, and those that it alone does."""
    w = Window.partitionBy("sample_id")
    x = p.withColumn("_bad", (~F.col("valid")).cast("int")).withColumn("_all", F.sum("_bad").over(w))
    return x.groupBy("band").agg(F.sum("_bad").alias("n_invalidated"), F.sum(F.when((F.col("_bad") == 1) & (F.col("_all") == 1), 1).otherwise(0)).alias("n_sole_cause"))


def window_features(p: DataFrame, window: int) -> DataFrame:
    """Centre pixel and mean of each valid patch."""
    mean = F.aggregate("patch", F.lit(0.0), lambda s, v: s + v) / (window * window)
    return p.where("valid").select("sample_id", "band", F.get("patch", F.lit(window * window // 2)).alias("centre"), mean.alias("window_mean"))


def ring_means(p: DataFrame, window: int) -> DataFrame:
    """Mean of each valid patch by ring: the larger of the row and column distances from the centre."""
    h = window // 2
    x = p.where("valid").select("sample_id", "band", F.posexplode("patch").alias("pos", "value"))
    ring = F.greatest(F.abs(F.col("pos") % window - h), F.abs(F.floor(F.col("pos") / window) - h)).cast("int")
    return x.groupBy("band", ring.alias("ring")).agg(F.count("*").alias("n"), F.avg("value").alias("mean"))


def regular_sample(cells: DataFrame, every: int) -> DataFrame:
    """Every n-th valid cell along rows and columns."""
    return cells.where(finite("value") & (F.col("row") % every == 0) & (F.col("col") % every == 0))


def ensemble_bands(preds: DataFrame, lower: float = 0.0) -> DataFrame:
    """By sample: median, mean, sd, mad, min and max over seeds of the clamped predictions."""
    p = F.greatest(F.col("pred"), F.lit(lower))
    x = preds.withColumn("p", p).withColumn("_m", F.median(p).over(Window.partitionBy("sample_id")))
    return x.groupBy("sample_id").agg(
        F.median("p").alias("median"), F.avg("p").alias("mean"), F.coalesce(F.stddev_samp("p"), F.lit(0.0)).alias("sd"),
        (F.median(F.abs(F.col("p") - F.col("_m"))) * 1.4826).alias("mad"), F.min("p").alias("min"), F.max("p").alias("max"),
    )


def band_summary(bands: DataFrame, names: list[str]) -> DataFrame:
    """By band: count, least, largest and mean."""
    z = F.explode(F.array(*[F.struct(F.lit(n).alias("band"), F.col(n).alias("value")) for n in names]))
    return bands.select(z.alias("z")).select("z.*").groupBy("band").agg(F.count("value").alias("n"), F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"))
