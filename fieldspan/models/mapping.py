"""Predictions over a raster of cells, tile by tile with a halo."""

from __future__ import annotations

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import get_model


def with_halo(cells: DataFrame, tile: int, h: int) -> DataFrame:
    """cells with tile_r and tile_c, repeated in each tile whose halo of h cells they are in. tile >= h."""
    if tile < h:
        raise ValueError("a tile must not be narrower than its halo")
    near = lambda c: F.explode(F.array_distinct(F.array(*[F.floor((F.col(c) + o) / tile).cast("int") for o in (-h, 0, h)])))
    return cells.withColumn("tile_r", near("row")).withColumn("tile_c", near("col"))


def predict_tiles(cells: DataFrame, model: str, fitted: list, bands: list[str], window: int, tile: int = 128, lower: float = float("-inf")) -> DataFrame:
    """row, col, preds: what each fitted model says of each cell whose whole window is finite in all bands.

    One task holds a tile with its halo, (tile + window - 1)^2 cells a band, whatever the raster's size; halos are
    repeated rows of the scan, and each patch is cut once for all models.
    """
    spec, h, n = get_model(model), window // 2, tile + window - 1

    def run(key, t: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = int(key[0]) * tile - h, int(key[1]) * tile - h
        x = np.full((len(bands), n, n), np.nan)
        x[t.band.map({b: i for i, b in enumerate(bands)}).to_numpy(int), t.row.to_numpy(int) - r0, t.col.to_numpy(int) - c0] = t.value.to_numpy(float)
        views = sliding_window_view(x, (window, window), axis=(1, 2))
        whole = sliding_window_view(np.isfinite(x).all(0), (window, window)).all((2, 3))
        r, c = np.nonzero(whole)
        out = np.empty((len(fitted), len(r)))
        for i in range(0, len(r), 4096):
            # Row offset fastest, as patches are stored.
            z = views[:, r[i : i + 4096], c[i : i + 4096]].transpose(1, 0, 3, 2).reshape(len(r[i : i + 4096]), -1)
            for k, f in enumerate(fitted):
                out[k, i : i + 4096] = np.maximum(spec.predict(f, z), lower)
        return pd.DataFrame({"row": r + r0 + h, "col": c + c0 + h, "preds": pd.Series(out.T.tolist(), dtype=object)})

    wanted = with_halo(cells.where(F.col("band").isin(bands)).select("band", "row", "col", "value"), tile, h)
    return wanted.groupBy("tile_r", "tile_c").applyInPandas(run, "row int, col int, preds array<double>")


def bands(preds: DataFrame) -> DataFrame:
    """row, col, and median, mean, sd, least and largest over the models."""
    p, n = F.array_sort("preds"), F.size("preds")
    mean = F.aggregate(p, F.lit(0.0), lambda s, v: s + v) / n
    sd = F.when(n > 1, F.sqrt(F.aggregate(p, F.lit(0.0), lambda s, v: s + (v - F.col("mean")) * (v - F.col("mean"))) / (n - 1))).otherwise(0.0)
    median = (F.get(p, F.floor((n - 1) / 2).cast("int")) + F.get(p, F.floor(n / 2).cast("int"))) / 2
    return preds.withColumn("mean", mean).select("row", "col", median.alias("median"), "mean", sd.alias("sd"), F.array_min("preds").alias("min"), F.array_max("preds").alias("max"))


def work_units(n_rows: int, n_cols: int, unit_rows: int, spark) -> DataFrame:
    """Bands of whole rows: unit, first and last row, number of cells."""
    u = spark.range(-(-n_rows // unit_rows)).withColumnRenamed("id", "unit")
    first = F.col("unit") * unit_rows
    last = F.least(first + unit_rows, F.lit(n_rows)) - 1
    return u.select("unit", first.alias("first_row"), last.alias("last_row"), ((last - first + 1) * n_cols).alias("n_cells"))
