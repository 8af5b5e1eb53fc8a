"""Keyed table steps: joins that refuse misses, upserts, first rows, pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def strict_join(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Each row of df with its row of other; a row without one raises an error when the result is computed."""
    x = df.join(other.withColumn("_hit", F.lit(True)), keys, "left")
    text = F.concat_ws(", ", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys])
    return x.where(F.when(F.col("_hit"), True).otherwise(F.raise_error(F.concat(F.lit("no match for "), text)).cast("boolean"))).drop("_hit")


def first_rows(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row of least `order` of each key. One row a key is kept before the shuffle, so hot keys cost no more."""
    row = F.struct(order, *[c for c in df.columns if c != order])
    return df.groupBy(F.col(key).alias("_k")).agg(F.min_by(row, F.col(order)).alias("_r")).select("_r.*").select(*df.columns)


def upsert(table: DataFrame, records: DataFrame, keys: list[str]) -> DataFrame:
    """table with the rows of records, which replace rows of the same keys; columns that one side lacks are null there."""
    both = table.withColumn("_late", F.lit(0)).unionByName(records.withColumn("_late", F.lit(1)), allowMissingColumns=True)
    last = Window.partitionBy(*keys).orderBy(F.desc("_late"))
    return both.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "_late")


def paired(a: DataFrame, b: DataFrame, on: list[str], metric: str) -> DataFrame:
    """metric of a and of b side by side where both have the keys, and how much b exceeds a."""
    x = a.select(*on, F.col(metric).alias("a")).join(b.select(*on, F.col(metric).alias("b")), on)
    return x.withColumn("difference", F.col("b") - F.col("a"))
