"""Text tables with semicolons between fields and decimal commas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_REAL = ("double", "float")


def write(df: DataFrame, path: str) -> None:
    """One folder of part files with headers; doubles in full precision. Refuses a path that exists."""
    df.select(*[F.translate(F.col(c).cast("string"), ".", ",").alias(c) if t in _REAL else F.col(c) for c, t in df.dtypes]).write.option("sep", ";").option("header", True).csv(path)


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table of the given DDL schema; fields that are no numbers are null in number columns."""
    want = spark.createDataFrame([], schema).schema
    raw = ", ".join(f"`{f.name}` {'string' if f.dataType.simpleString() in _REAL else f.dataType.simpleString()}" for f in want)
    x = spark.read.schema(raw).option("sep", ";").option("header", True).csv(path)
    return x.select(*[F.translate(f.name, ",", ".").try_cast(f.dataType).alias(f.name) if f.dataType.simpleString() in _REAL else F.col(f.name) for f in want])
