"""Preparing points and rasters, and the patch store with its manifest."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import finite
from .raster import patches, predictor_types

CONTRACT = ("profile_id", "sample_id", "target_native", "target_transform")
RULES = "predictor string, na_below double, clamp_lower double, clamp_upper double"


def check_contract(points: DataFrame, need: Sequence[str] = CONTRACT) -> DataFrame:
    """points, if it has the columns that every later step relies on."""
    lost = [c for c in need if c not in points.columns]
    if lost:
        raise ValueError(f"points lack {', '.join(lost)}")
    return points


def target_transform(name: str) -> tuple:
    """(forward, inverse) of a named transform of the target, as functions of columns; none and log1p are known."""
    if name == "none":
        return (lambda c: c, lambda c: c)
    if name == "log1p":
        return (F.log1p, F.expm1)
    raise ValueError(f"no such transform: {name!r}")


def matched(patterns: Sequence[str], names: Sequence[str]) -> tuple[list[str], list[str]]:
    """Names that any pattern finds, and patterns that find nothing."""
    return [n for n in names if any(re.search(p, n) for p in patterns)], [p for p in patterns if not any(re.search(p, n) for n in names)]


def qc_table(spark: SparkSession, predictors: Sequence[str], na_below: dict[str, float] | None = None, clamp: Sequence[str] = (), limits: tuple[float, float] = (0.0, 100.0), by_regex: bool = True) -> DataFrame:
    """A rule for each predictor: at or below which value it is missing (by name or pattern, the last that fits), and its range."""
    rows = []
    for p in predictors:
        floor = None
        for pattern, v in (na_below or {}).items():
            if re.search(pattern, p) if by_regex else pattern == p:
                floor = float(v)
        rows.append((p, floor, *(limits if p in clamp else (None, None))))
    return spark.createDataFrame(rows, RULES)


def apply_qc(long: DataFrame, rules: DataFrame, key: str = "predictor", value: str = "value") -> DataFrame:
    """long with sentinels as null and finite values clamped, by the rules of each predictor (a row a predictor)."""
    r = F.broadcast(rules.select(F.col("predictor").alias("_p"), "na_below", "clamp_lower", "clamp_upper"))
    v = F.when(~finite(value) | F.col("na_below").isNull() | (F.col(value) > F.col("na_below")), F.col(value))
    low, high = F.col("clamp_lower"), F.col("clamp_upper")
    kept = F.when(finite(v) & low.isNotNull(), F.least(F.greatest(v, low), high)).otherwise(v)
    return long.join(r, F.col(key) == F.col("_p"), "left").withColumn(value, kept).drop("_p", "na_below", "clamp_lower", "clamp_upper")


def centre_in_bounds(row: Column, col: Column, n_rows: int, n_cols: int, window: int) -> Column:
    """Whether a window around a centre, counted from 0, lies within the raster."""
    h = window // 2
    return row.between(h, n_rows - 1 - h) & col.between(h, n_cols - 1 - h)


def to_cells(points: DataFrame, xmin: float, ymax: float, size: float) -> DataFrame:
    """points (x, y) with the row and col of the raster cell they are in, row 0 in the north."""
    at = lambda c: F.floor(c / size).cast("int")
    return points.withColumn("row", at(F.lit(ymax) - F.col("y"))).withColumn("col", at(F.col("x") - F.lit(xmin)))


def crop(cells: DataFrame, extent: tuple[float, float, float, float], xmin: float, ymax: float, size: float) -> DataFrame:
    """Cells of a raster that an extent (xmin, xmax, ymin, ymax) touches, within a millionth of a cell; a filter that reaches the scan."""
    x0, x1, y0, y1 = extent
    tiny = 1e-6
    rows = (int((ymax - y1) / size + tiny), int(-(-((ymax - y0) / size - tiny) // 1)) - 1)
    cols = (int((x0 - xmin) / size + tiny), int(-(-((x1 - xmin) / size - tiny) // 1)) - 1)
    return cells.where(F.col("row").between(*rows) & F.col("col").between(*cols))


def prepare(points: DataFrame, cells: DataFrame, rules: DataFrame, windows: Sequence[int], transform: str = "none") -> dict[str, DataFrame]:
    """Quality-controlled samples, patches and channel facts of points (sample_id, profile_id, row, col, target) and cells (band, row, col, value).

    A sample stays if its target is finite and the largest window around it is finite in every band. Returns
    `samples` (the point contract), `patches` (sample_id, window, band, patch), `types` (facts of each band over the samples
    that stay) and `dropped` (reason, n).
    """
    forward, _ = target_transform(transform)
    clean = apply_qc(cells, rules, "band")
    bands = clean.agg(F.count_distinct("band").alias("_bands"))
    usable = points.where(finite("target"))
    top = max(windows)
    largest = patches(clean, usable, top)
    whole = largest.where("valid").groupBy("sample_id").agg(F.count("*").alias("_n")).join(F.broadcast(bands), F.col("_n") == F.col("_bands")).select("sample_id")
    samples = usable.join(whole, "sample_id", "left_semi")
    samples = samples.select("sample_id", "profile_id", "row", "col", F.col("target").alias("target_native"), forward(F.col("target")).alias("target_transform"))
    out = None
    for w in sorted(windows):
        part = (largest if w == top else patches(clean, usable, w)).join(whole, "sample_id", "left_semi").select("sample_id", F.lit(w).alias("window"), "band", "patch")
        out = part if out is None else out.unionByName(part)
    centres = largest.join(whole, "sample_id", "left_semi").select(F.col("band").alias("predictor"), F.get("patch", F.lit(top * top // 2)).alias("value"))
    gone = points.select(F.when(~finite("target"), "target").alias("reason"), "sample_id").join(whole.withColumn("_in", F.lit(True)), "sample_id", "left")
    dropped = gone.where("reason is not null or _in is null").groupBy(F.coalesce("reason", F.lit("patch")).alias("reason")).agg(F.count("*").alias("n"))
    return {"samples": samples, "patches": out, "types": predictor_types(centres), "dropped": dropped}


def write_store(prepared: dict[str, DataFrame], path: str, spec: dict) -> None:
    """Write samples and patches (by window) and, last of all, the manifest: a store without one is not complete."""
    spark = prepared["samples"].sparkSession
    prepared["samples"].write.parquet(f"{path}/samples")
    prepared["patches"].write.partitionBy("window").parquet(f"{path}/patches")
    spark.createDataFrame([(json.dumps(spec | {"store_complete": True, "scaling_applied": False}, sort_keys=True),)], "value string").coalesce(1).write.text(f"{path}/manifest")


def store_spec(spark: SparkSession, path: str) -> dict:
    """What a store was built under: predictors, windows, target, transform, cell_size."""
    return json.loads(spark.read.text(f"{path}/manifest").first()["value"])


def check_spec(spec: dict, **want) -> dict:
    """spec, if it has the predictors (in that order), windows, target, transform and cell_size (to 1e-9) that are wanted."""
    bad = []
    for name, v in want.items():
        have = spec.get(name)
        same = abs(have - v) <= 1e-9 * max(1.0, abs(v)) if name == "cell_size" and have is not None else list(have or []) == list(v) if name == "predictors" else set(have or []) >= set(v) if name == "windows" else have == v
        if not same:
            bad.append(f"{name}: {have!r}, not {v!r}")
    if bad or not spec.get("store_complete"):
        raise ValueError("the store does not fit: " + "; ".join(bad or ["it is not complete"]))
    return spec


def read_store(spark: SparkSession, path: str, window: int, **want) -> tuple[DataFrame, DataFrame]:
    """Samples, and patches of one window (only its files are read)."""
    check_spec(store_spec(spark, path), windows=[window], **want)
    return spark.read.parquet(f"{path}/samples"), spark.read.parquet(f"{path}/patches").where(F.col("window") == window)


def align(points: DataFrame, samples: DataFrame) -> DataFrame:
    """The points of the store's samples, one each; a sample without a point, or with two, is refused."""
    got = samples.select("sample_id").join(points.withColumn("_hit", F.lit(1)), "sample_id", "left")
    bad = got.groupBy("sample_id").agg(F.count("_hit").alias("n")).where("n <> 1").count()
    if bad:
        raise ValueError(f"{bad} samples of the store do not have exactly one point")
    return got.drop("_hit")


def valid_fold_points(samples: DataFrame, plan: DataFrame) -> DataFrame:
    """Samples of the store with each fold and role they have."""
    return plan.join(samples, "sample_id")


def fill_values(long: DataFrame, scaling: DataFrame) -> DataFrame:
    """By (fold, predictor): the mean of its training rows, and what that is once scaled."""
    m = long.groupBy("fold", "predictor").agg(F.avg("value").alias("fill"))
    return m.join(scaling, ["fold", "predictor"]).select("fold", "predictor", "fill", ((F.col("fill") - F.col("center")) / F.col("scale")).alias("fill_scaled"))
