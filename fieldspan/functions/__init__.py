"""Column expressions shared by the operators."""

from __future__ import annotations

import atexit
import math
import shutil
import tempfile
import uuid
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def finite(c: Column | str) -> Column:
    """Neither null, NaN nor infinite."""
    c = F.col(c) if isinstance(c, str) else c
    c = c.cast("double")
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def only_finite(df: DataFrame, *cols: str) -> DataFrame:
    for c in cols:
        df = df.where(finite(c))
    return df


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or null."""
    return F.when(b != 0, a / b)


def draw_key(seed: int, key: Column | str) -> Column:
    """A reproducible random order of keys: the same in any engine that has md5."""
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}_"), key.cast("string")))


def laea(lon: Column, lat: Column, lon0: float, lat0: float, radius: float = 6371.0072) -> tuple[Column, Column]:
    """Kilometres east and north of a centre, spherical Lambert azimuthal equal-area."""
    p, p0, d = F.radians(lat), F.radians(F.lit(lat0)), F.radians(lon - F.lit(lon0))
    cosc = F.sin(p0) * F.sin(p) + F.cos(p0) * F.cos(p) * F.cos(d)
    k = F.sqrt(2 / (1 + cosc)) * radius
    return k * F.cos(p) * F.sin(d), k * (F.cos(p0) * F.sin(p) - F.sin(p0) * F.cos(p) * F.cos(d))


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = 6371.0088) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def d4(patch: Column, w: int, k: int) -> Column:
    """One of the eight symmetries of a square patch of w * w cells, row offset fastest."""
    order = []
    for c in range(w):
        for r in range(w):
            a, b = (c, r) if k >= 4 else (r, c)
            for _ in range(k % 4):
                a, b = b, w - 1 - a
            order.append(b * w + a)
    return F.transform(F.array(*[F.lit(i) for i in order]), lambda i: F.get(patch, i))


def running_sum(df: DataFrame, order: str, value: str, out: str, by: list[str] = (), parts: int = 64) -> DataFrame:
    """out: the sum of `value` over the rows of the same group whose `order` is not larger; no task holds a whole group.

    `order` is a number, cut at approximate quantiles of the table, or an md5, cut by its first three digits. Sums of
    the cuts before a row's own are at most a few thousand rows a group; the window runs inside a cut.
    """
    by = list(by)
    if dict(df.dtypes)[order] == "string":
        x = df.withColumn("_b", F.conv(F.substring(order, 1, 3), 16, 10).cast("int"))
    else:
        edges = df.agg(F.percentile_approx(order, [i / parts for i in range(1, parts)], 1000).alias("_e"))
        x = df.crossJoin(F.broadcast(edges)).withColumn("_b", F.size(F.filter("_e", lambda v: v < F.col(order)))).drop("_e")
    cuts = x.groupBy(*by, "_b").agg(F.sum(value).alias("_t"))
    before = cuts.withColumn("_t", F.sum("_t").over(Window.partitionBy(*by).orderBy("_b")) - F.col("_t"))
    x = x.join(before, [*by, "_b"])
    return x.withColumn(out, F.col("_t") + F.sum(value).over(Window.partitionBy(*by, "_b").orderBy(order))).drop("_b", "_t")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder all executors share: spark.checkpoint.dir, else the warehouse, else (in local mode) one of our own."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where and spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master:
        where = tempfile.mkdtemp(prefix="fieldspan-")
        atexit.register(shutil.rmtree, where, ignore_errors=True)
    return f"{(where or spark.conf.get('spark.sql.warehouse.dir')).rstrip('/')}/fieldspan/{uuid.uuid4().hex}/{name}"


#: Reads of what was kept.
READS = 4


def kept(df: DataFrame, name: str) -> DataFrame:
    """df, made once and read from the folder all executors share."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return in_reads(df.sparkSession, path)


def in_reads(spark, path: str) -> DataFrame:
    """The table of a folder as some reads of a part of its files each: one alone packs them into a task a core and a rest that all wait for."""
    whole = spark.read.parquet(path)
    files = sorted(unquote(f) for f in whole.inputFiles())
    parts = [spark.read.schema(whole.schema).parquet(*files[i::READS]) for i in range(min(READS, len(files)))]
    return reduce(DataFrame.union, parts) if parts else whole


def mollweide(lon: Column, lat: Column, radius: float = 6378.137) -> tuple[Column, Column]:
    """Equal-area kilometres east and north of (0, 0), from degrees. The auxiliary angle comes from ten Newton steps."""
    phi = F.radians(lat)
    step = lambda t, _: t - (2 * t + F.sin(2 * t) - math.pi * F.sin(phi)) / (2 + 2 * F.cos(2 * t))
    # At the poles the slope is zero, and the angle is known.
    t = F.when(F.abs(lat) >= 90, F.signum(lat) * (math.pi / 2)).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(10)), phi, step))
    return 2 * math.sqrt(2) / math.pi * radius * F.radians(lon) * F.cos(t), math.sqrt(2) * radius * F.sin(t)
