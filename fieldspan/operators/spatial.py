"""Inference on clustered points, dissimilarity, and equal-area blocks."""

from __future__ import annotations

import itertools
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import finite, haversine, laea, running_sum


def equal_area_blocks(df: DataFrame, size_km: float, lon0: float, lat0: float) -> DataFrame:
    """block: the square of an equal-area projection that (lon, lat) is in."""
    e, n = laea(F.col("lon"), F.col("lat"), lon0, lat0)
    at = lambda c: F.floor(c / size_km).cast("string")
    return df.withColumn("block", F.concat_ws("_", at(e), at(n)))


def correlogram(df: DataFrame, breaks: list[float], lonlat: bool = False) -> DataFrame:
    """Moran's I by distance class [a, b). Pairs come from neighbouring buckets of the largest distance, not from all rows.

    df has id, x, y, value; rows of one place meet others as one. Longitudes and latitudes are first put on the sphere, where buckets are cubes of the largest
    distance, so that pairs across the date line and near the poles meet as well.
    """
    m = df.agg(F.avg("value").alias("_m"), F.var_pop("value").alias("_v"), F.count("*").alias("_n"))
    z = df.crossJoin(F.broadcast(m)).withColumn("z", F.col("value") - F.col("_m"))
    if lonlat:
        # A chord is never longer than its arc, so buckets of the largest distance hold all pairs.
        lon, lat, radius = F.radians("x"), F.radians("y"), 6371.0088
        place = [radius * F.cos(lat) * F.cos(lon), radius * F.cos(lat) * F.sin(lon), radius * F.sin(lat)]
    else:
        place = [F.col("x"), F.col("y")]
    names = ["i", "j", "k"][: len(place)]
    cells = [F.floor(c / breaks[-1]).cast("long") for c in place]
    # Rows of one place are one: pairs need their number, the sum of z and, among themselves, the sum of its squares.
    known = z.where(F.col("id").isNotNull() & finite("x") & finite("y"))
    z = known.groupBy(*[c.alias(n) for c, n in zip(cells, names, strict=True)], "x", "y").agg(F.count("*").alias("w"), F.count("z").alias("v"), F.sum("z").alias("z"), F.sum(F.col("z") * F.col("z")).alias("zz"))
    own = z.select(F.lit(0.0).alias("d"), (F.col("w") * (F.col("w") - 1) / 2).alias("n"), (F.col("v") * (F.col("v") - 1) / 2).alias("m"), ((F.col("z") * F.col("z") - F.col("zz")) / 2).alias("s"))
    # Rows of one id are no pair: theirs are taken off again.
    twice = known.groupBy("id").agg(F.count("*").alias("_k")).where("_k > 1").select("id")
    twice = known.hint("merge").join(twice, "id", "left_semi").groupBy("id").agg(F.collect_list(F.struct("x", "y", "z")).alias("r"))
    twice = twice.select("r", F.posexplode("r").alias("i", "a")).select("i", "a", F.posexplode("r").alias("j", "b")).where("i < j")
    twice = twice.select(*[F.col(f"{t}.{c}").alias(f"{c}{t}") for t in "ab" for c in "xyz"])
    a = z.select(F.col("x").alias("xa"), F.col("y").alias("ya"), F.col("z").alias("za"), F.col("w").alias("wa"), F.col("v").alias("va"), *names)
    steps = [F.struct(*[F.lit(v).alias(n) for v, n in zip(step, names, strict=True)]) for step in itertools.product((-1, 0, 1), repeat=len(names))]
    b = z.withColumn("_d", F.explode(F.array(*steps)))
    b = b.select(F.col("x").alias("xb"), F.col("y").alias("yb"), F.col("z").alias("zb"), F.col("w").alias("wb"), F.col("v").alias("vb"), *[(F.col(n) + F.col(f"_d.{n}")).alias(n) for n in names])
    p = a.hint("merge").join(b, names).where("xa < xb or (xa = xb and ya < yb)")
    d = haversine(F.col("xa"), F.col("ya"), F.col("xb"), F.col("yb")) if lonlat else F.sqrt(F.pow(F.col("xa") - F.col("xb"), 2) + F.pow(F.col("ya") - F.col("yb"), 2))
    p = p.select(d.alias("d"), (F.col("wa") * F.col("wb")).cast("double").alias("n"), (F.col("va") * F.col("vb")).cast("double").alias("m"), (F.col("za") * F.col("zb")).alias("s")).unionByName(own)
    p = p.unionByName(twice.select(d.alias("d"), F.lit(-1.0).alias("n"), F.when(F.col("za").isNull() | F.col("zb").isNull(), 0.0).otherwise(-1.0).alias("m"), (-F.col("za") * F.col("zb")).alias("s")))
    klass = F.lit(None).cast("int")
    for i in range(len(breaks) - 2, -1, -1):
        klass = F.when((F.col("d") >= breaks[i]) & (F.col("d") < breaks[i + 1]), i + 1).otherwise(klass)
    sums = p.withColumn("class", klass).where("class is not null and n <> 0").groupBy("class").agg(F.sum("n").cast("long").alias("n_pairs"), (F.sum("s") / F.nullif(F.sum("m"), F.lit(0.0))).alias("_i")).where("n_pairs > 0")
    return sums.crossJoin(F.broadcast(m)).select("class", "n_pairs", (F.col("_i") / F.col("_v")).alias("moran"), (F.lit(-1.0) / (F.col("_n") - 1)).alias("expected"))


def _sums(df: DataFrame, block: str, pred: str, weight: str) -> DataFrame:
    """What the metrics need of each block: sums of errors, and of observations and predictions less the mean observation."""
    middle = df.agg(F.avg("obs").alias("_c"))
    o, p = F.col("obs") - F.col("_c"), F.col(pred) - F.col("_c")
    e = p - o
    parts = {"n": F.lit(1.0), "a": F.abs(e), "q": e * e, "e": e, "o": o, "p": p, "oo": o * o, "pp": p * p, "op": o * p}
    s = df.crossJoin(F.broadcast(middle)).groupBy(F.col(block).cast("string").alias("b")).agg(*[F.sum(v).alias(c) for c, v in parts.items()])
    return s if weight == "profile" else s.select("b", *[(F.col(c) / F.col("n")).alias(c) for c in parts])


def _boot_metrics(x: DataFrame, keys: list[str]) -> DataFrame:
    n = F.col("n")
    mo, mp = F.col("o") / n, F.col("p") / n
    vo, vp, c = F.col("oo") / n - mo * mo, F.col("pp") / n - mp * mp, F.col("op") / n - mo * mp
    ccc = 2 * c / F.nullif(vo + vp + (mo - mp) * (mo - mp), F.lit(0.0))
    values = {"mae": F.col("a") / n, "rmse": F.sqrt(F.col("q") / n), "bias": F.col("e") / n, "ccc": ccc}
    return x.select(*keys, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), v.alias("value")) for m, v in values.items()])).alias("v")).select(*keys, "v.*")


def block_bootstrap(df: DataFrame, block: str, n_boot: int = 200, seed: int = 42, conf: float = 0.95, against: str | None = None, weight: str = "profile") -> DataFrame:
    """mae, rmse, bias and ccc of pred with whole-block bootstrap limits; with `against`, of pred less that column's, on the same draws.

    Only blocks, as sums, are drawn again. Blocks are numbered in the order of their md5; draw i of replicate r is block
    number (first 8 hex digits of md5(seed_r_i)) modulo their count. weight "block" lets each block count once.
    """
    sums = ["n", "a", "q", "e", "o", "p", "oo", "pp", "op"]
    both = ["pred", against] if against else ["pred"]
    s = None
    for name in both:
        part = _sums(df, block, name, weight).withColumn("model", F.lit(name))
        s = part if s is None else s.unionByName(part)
    numbers = s.where("model = 'pred'").select("b", F.md5("b").alias("_h"), F.lit(1).alias("_1"))
    numbers = running_sum(numbers, "_h", "_1", "_k").select("b", (F.col("_k") - 1).alias("k"))
    count = numbers.agg(F.count("*").alias("m"))
    draws = numbers.crossJoin(F.broadcast(count)).select("m", F.explode(F.sequence(F.lit(1), F.lit(n_boot))).alias("r"), (F.col("k") + 1).alias("i"))
    code = F.conv(F.substring(F.md5(F.concat_ws("_", F.lit(str(seed)), F.col("r").cast("string"), F.col("i").cast("string"))), 1, 8), 16, 10).cast("long")
    drawn = draws.select("r", (code % F.col("m")).alias("k")).groupBy("r", "k").agg(F.count("*").alias("w"))
    again = drawn.join(numbers, "k").join(s, "b").groupBy("r", "model").agg(*[F.sum(F.col(c) * F.col("w")).alias(c) for c in sums])
    reps = _boot_metrics(again, ["r", "model"])
    point = _boot_metrics(s.groupBy("model").agg(*[F.sum(c).alias(c) for c in sums]), ["model"])
    if against:
        less = lambda x, keys: x.groupBy(*keys).agg((F.max(F.when(F.col("model") == "pred", F.col("value"))) - F.max(F.when(F.col("model") == against, F.col("value")))).alias("value"))
        reps, point = less(reps, ["r", "metric"]), less(point, ["metric"])
    limits = reps.groupBy("metric").agg(F.percentile("value", F.lit((1 - conf) / 2)).alias("lower"), F.percentile("value", F.lit((1 + conf) / 2)).alias("upper"))
    return point.select("metric", F.col("value").alias("estimate")).join(limits, "metric")


def _in_blocks(df: DataFrame, cols: list[str], rows: int, blocks_of: str) -> DataFrame:
    """One row for about `rows` rows: block, and the columns as arrays."""
    n = df.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / rows)).alias("_n"))
    x = df.crossJoin(F.broadcast(n)).withColumn("block", F.pmod(F.xxhash64("id"), F.col("_n")))
    rows_ = x.groupBy("block").agg(F.collect_list(F.struct(*cols)).alias("_r"))
    return rows_.select(F.col("block").alias(f"block_{blocks_of}"), *[F.col(f"_r.{c}").alias(f"{c}_{blocks_of}") for c in cols])


def di_reference(train: DataFrame) -> DataFrame:
    """Mean distance of all pairs of a training cloud (id, v): the unit of dissimilarity.

    Blocks of 512 rows meet in pairs, so every pair of rows counts once and no task holds the cloud.
    """
    kept = train.select("id", "v")
    a, b = _in_blocks(kept, ["v"], 512, "a"), _in_blocks(kept, ["v"], 512, "b")

    def sums(batches):
        s, n = 0.0, 0
        for t in batches:
            for k in range(t.num_rows):
                d = _squared(_matrix(t["v_a"][k]), _matrix(t["v_b"][k]))
                np.sqrt(d, out=d)
                if t["block_a"][k] == t["block_b"][k]:
                    s, n = s + float(np.triu(d, 1).sum()), n + len(d) * (len(d) - 1) // 2
                else:
                    s, n = s + float(d.sum()), n + d.size
        if n:
            yield pa.RecordBatch.from_pydict({"s": [s], "n": [n]})

    pairs = a.crossJoin(b).where("block_a <= block_b").mapInArrow(sums, "s double, n long")
    return pairs.agg((F.sum("s") / F.sum("n")).alias("avg_dist"), F.sum("n").alias("n_pairs"))


def _matrix(rows: pa.Scalar) -> np.ndarray:
    """A block's vectors, of one length, from Arrow's own buffer: no object is made for a vector."""
    v = rows.values
    if v.null_count or len(pc.unique(pc.list_value_length(v))) > 1:
        raise ValueError("vectors are missing or of different lengths")
    return np.asarray(v.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(v), -1)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a @ b.T
    d *= -2
    d += (a * a).sum(1)[:, None]
    d += (b * b).sum(1)[None]
    return np.maximum(d, 0, out=d)


def nearest(x: DataFrame, train: DataFrame, other_folds: bool = False) -> DataFrame:
    """(id, d): the distance of each row of x to the nearest row of train, of another fold if other_folds.

    Blocks of a thousand rows of either side meet, so no side has to fit in a task; one row an id and block pair is shuffled.
    """
    cols = ["id", "v", "fold"] if other_folds else ["id", "v"]
    pairs = _in_blocks(x, cols, 1024, "a").crossJoin(_in_blocks(train, cols, 1024, "b"))

    def least(batches):
        fold = lambda f: np.asarray(f.values.cast(pa.float64()).to_numpy(zero_copy_only=False))
        for t in batches:
            for k in range(t.num_rows):
                a, b = _matrix(t["v_a"][k]), _matrix(t["v_b"][k])
                sq = _squared(a, b)
                if other_folds:
                    sq[fold(t["fold_a"][k])[:, None] == fold(t["fold_b"][k])[None]] = np.inf
                at = sq.argmin(1)
                d = np.where(np.isfinite(sq[np.arange(len(a)), at]), np.sqrt(((a - b[at]) ** 2).sum(1)), np.inf)
                yield pa.RecordBatch.from_arrays([t["id_a"][k].values.cast(pa.int64()), pa.array(d)], ["id", "d"])

    return pairs.mapInArrow(least, "id long, d double").groupBy("id").agg(F.min("d").alias("d"))


def _in_units(near: DataFrame, unit: DataFrame) -> DataFrame:
    return near.crossJoin(F.broadcast(unit)).select("id", (F.col("d") / F.col("avg_dist")).alias("di"))


def dissimilarity(train: DataFrame, x: DataFrame, unit: DataFrame) -> DataFrame:
    """Distance of each row of x (id, v) to the nearest training row, in units of avg_dist."""
    return _in_units(nearest(x, train), unit)


def cross_fold_di(train: DataFrame, unit: DataFrame) -> DataFrame:
    """Dissimilarity of each row (id, v, fold) that has a fold to the rows of other folds and of none. Rows without a fold are only neighbours."""
    return _in_units(nearest(train.where("fold is not null"), train, other_folds=True), unit)


def aoa_threshold(cv_di: DataFrame, k_iqr: float = 1.5) -> DataFrame:
    """Upper quartile plus k_iqr interquartile ranges of the cross-fold dissimilarity."""
    q = cv_di.agg(F.percentile("di", F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    return q.select((F.col("q")[1] + k_iqr * (F.col("q")[1] - F.col("q")[0])).alias("threshold"))


def inside_aoa(di: DataFrame, threshold: DataFrame) -> DataFrame:
    return di.crossJoin(F.broadcast(threshold)).withColumn("inside", F.col("di") <= F.col("threshold"))


def scaled_vectors(rows: DataFrame, center: list[float], scale: list[float], weights: list[float] | None = None) -> DataFrame:
    """v of rows as weighted, scaled channels; null where a channel is missing or not finite."""
    parts = [F.array(*[F.lit(float(z)) for z in c]) for c in (center, scale, weights or [1.0] * len(center))]
    at = lambda k, i: F.get(parts[k], i)
    v = F.transform(F.col("v").cast("array<double>"), lambda c, i: (c - at(0, i)) / at(1, i) * at(2, i))
    whole = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c) < float("inf"))) & (F.size("v") == len(center))
    return rows.withColumn("v", F.when(whole, v))


class Reference(NamedTuple):
    """What the dissimilarity of new rows is measured by."""

    train: DataFrame
    unit: DataFrame
    threshold: DataFrame
    center: list[float]
    scale: list[float]
    weights: list[float] | None


def aoa_reference(points: DataFrame, center: list[float], scale: list[float], weights: list[float] | None = None, k_iqr: float = 1.5) -> Reference:
    """The reference of points (id, v, fold of validation): whole training vectors, their mean distance and the threshold."""
    train = scaled_vectors(points, center, scale, weights).where("v is not null").select("id", "v", "fold")
    unit = di_reference(train).select("avg_dist")
    return Reference(train, unit, aoa_threshold(cross_fold_di(train, unit), k_iqr), center, scale, weights)


def aoa_di(ref: Reference, rows: DataFrame) -> DataFrame:
    """id, di of raw rows (id, v); null where a channel is missing."""
    x = scaled_vectors(rows, ref.center, ref.scale, ref.weights).select("id", "v")
    known = dissimilarity(ref.train, x.where("v is not null"), ref.unit)
    return known.unionByName(x.where("v is null").select("id", F.lit(None).cast("double").alias("di")))


def aoa_report(di: DataFrame, threshold: DataFrame) -> DataFrame:
    """Rows with a dissimilarity, share inside the threshold, three quantiles; warn if less than half is inside."""
    x = di.where("di is not null").crossJoin(F.broadcast(threshold))
    q = F.percentile("di", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    x = x.agg(F.count("*").alias("n"), F.max("threshold").alias("threshold"), F.avg((F.col("di") <= F.col("threshold")).cast("int")).alias("share_inside"), q.alias("q"))
    return x.select("n", "threshold", "share_inside", *[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(("q05", "q50", "q95"))], (F.col("share_inside") < 0.5).alias("warn"))
