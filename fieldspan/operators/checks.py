"""Checks of what a run holds: patch centres, attributions, keys, run folders and times."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import finite


def patch_centres(patches: DataFrame, points: DataFrame, window: int, tol: float = 1e-6) -> DataFrame:
    """By band: whether the centre of each patch (sample_id, band, patch) is the value of the point table (sample_id, band, value).

    n pairs; n_missing: one of both is missing; n_off: they differ by more than tol. Both missing agree.
    """
    c = patches.select("sample_id", "band", F.get("patch", F.lit(window * window // 2)).alias("c"))
    x = c.join(points.select("sample_id", "band", "value"), ["sample_id", "band"])
    has_c, has_v = F.coalesce(finite("c"), F.lit(False)), F.coalesce(finite("value"), F.lit(False))
    gap = F.when(has_c & has_v, F.abs(F.col("c") - F.col("value")))
    sums = x.groupBy("band").agg(F.count("*").alias("n"), F.count_if(has_c != has_v).alias("n_missing"), F.count_if(gap > tol).alias("n_off"), F.max(gap).alias("max_gap"))
    return sums.withColumn("ok", (F.col("n_missing") == 0) & (F.col("n_off") == 0))


def attribution_gap(phi: DataFrame, totals: DataFrame, tol: float = 1e-5) -> DataFrame:
    """Whether the values (id, player, phi) of each id add up to its total (id, total): one row with n, the largest gap and n_off.

    A gap counts against tol times the largest of 1 and |total|; an id without values has a gap of its whole total.
    """
    x = totals.join(phi.groupBy("id").agg(F.sum("phi").alias("_s")), "id", "left")
    gap = F.abs(F.col("total") - F.coalesce("_s", F.lit(0.0)))
    off = gap > tol * F.greatest(F.lit(1.0), F.abs("total"))
    return x.agg(F.count("*").alias("n"), F.max(gap).alias("max_gap"), F.count_if(off).alias("n_off")).withColumn("ok", F.col("n_off") == 0)


def compare_keys(wanted: DataFrame, have: DataFrame) -> DataFrame:
    """Each distinct row of both, with status both, missing (wanted only) or unexpected."""
    have = have.select(*wanted.columns)
    return (
        wanted.intersect(have).withColumn("status", F.lit("both"))
        .union(wanted.subtract(have).withColumn("status", F.lit("missing")))
        .union(have.subtract(wanted).withColumn("status", F.lit("unexpected")))
    )


def latest_run(files: DataFrame, prefix: str, required: str) -> DataFrame:
    """run, modified: the newest run folder whose name starts with prefix and that holds the file `required`; ties to the last name.

    files: path, modified (as the binaryFile source lists them). An unfinished run lacks the file and does not count.
    """
    parts = F.split("path", "/")
    x = files.select(F.get(parts, F.size(parts) - 2).alias("run"), F.element_at(parts, -1).alias("_file"), "modified")
    x = x.where(F.startswith("run", F.lit(prefix)) & (F.col("_file") == required))
    return x.agg(F.max_by(F.struct("run", "modified"), F.struct("modified", "run")).alias("r")).where("r is not null").select("r.*")


def run_times(stamps: DataFrame, by: str, at: str) -> DataFrame:
    """Start, end, number of stamps and whole seconds between the first and the last, by run."""
    x = stamps.groupBy(by).agg(F.min(at).alias("started"), F.max(at).alias("ended"), F.count(at).alias("n"))
    return x.withColumn("seconds", F.timestamp_diff("SECOND", F.col("started"), F.col("ended")))


def describe_draw(rows: DataFrame, chosen: str, stratum: str) -> DataFrame:
    """One line on a draw of rows (a boolean column): rows drawn, their share, and the strata they come from."""
    drawn = F.col(chosen)
    x = rows.agg(F.count_if(drawn).alias("k"), F.count("*").alias("n"), F.count_distinct(F.when(drawn, F.col(stratum))).alias("s"), F.count_distinct(stratum).alias("t"))
    share = F.round(100 * F.col("k") / F.col("n"), 1)
    return x.select(F.format_string("%d of %d rows (%.1f %%) from %d of %d strata", "k", "n", share, "s", "t").alias("line"))


def calibrated_bands(cells: DataFrame, q: DataFrame, threshold: DataFrame | None = None, lower_limit: float = 0.0) -> DataFrame:
    """The bands of a calibrated map: cells (pred, and di if a threshold is given) with lower, upper, width and inside.

    q and threshold are tables of one row. Outside the area of applicability, and where q is infinite, a cell keeps its
    prediction and has no interval. The lower bound is not below lower_limit; width is of the bounds as they are.
    """
    x = cells.crossJoin(F.broadcast(q.select(F.col("q").alias("_q"))))
    ok = finite("_q")
    if threshold is not None:
        x = x.crossJoin(F.broadcast(threshold.select(F.col("threshold").alias("_t")))).withColumn("inside", F.coalesce(F.col("di") <= F.col("_t"), F.lit(False))).drop("_t")
        ok = ok & F.col("inside")
    x = x.withColumn("lower", F.when(ok, F.greatest(F.col("pred") - F.col("_q"), F.lit(lower_limit)))).withColumn("upper", F.when(ok, F.col("pred") + F.col("_q")))
    return x.withColumn("width", F.col("upper") - F.col("lower")).drop("_q")
