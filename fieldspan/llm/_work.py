"""Shared plumbing: the shared folder, written tables, size-checked broadcasts."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words everywhere in this subpackage: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: A side with at most so many narrow rows (two longs) may be broadcast: 16 MB.
BROADCAST_ROWS = 1_000_000

_own: dict[str, str] = {}
_scopes: dict[tuple[str, int], list[str]] = {}
_current = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset: the warehouse, or in local mode a folder of our own."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="fieldspan-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return _own[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/fieldspan/{uuid.uuid4().hex}/{name}"
    if getattr(_current, "names", None):
        _scopes.setdefault((_current.names[-1], threading.get_ident()), []).append(path)
    return path


#: Rows and bytes of an Arrow batch: whole texts are long, and both sides of the pipe hold a batch of each task.
BATCH_ROWS, BATCH_BYTES = 1024, 2 << 20


def short_batches(spark: SparkSession) -> None:
    """Python functions of this session get at most BATCH_ROWS rows or about BATCH_BYTES bytes at once from now on."""
    conf = "spark.sql.execution.arrow."
    if not 0 < int(spark.conf.get(conf + "maxRecordsPerBatch")) <= BATCH_ROWS:
        spark.conf.set(conf + "maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set(conf + "maxBytesPerBatch", str(BATCH_BYTES))


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts the lineage.

    The files outlive any executor; a lost one costs only its running tasks.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scope(name: str):
    """Tables that this thread keeps inside belong to `name`, so that drop_scope(name) in this thread can delete them."""
    if not hasattr(_current, "names"):
        _current.names = []
    _current.names.append(name)
    try:
        yield
    finally:
        _current.names.pop()


def drop_scope(spark: SparkSession, name: str) -> None:
    """Delete the tables of a scope of this thread. Only for results that have been written elsewhere."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in _scopes.pop((name, threading.get_ident()), []):
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


#: Bytes of text and lists that a broadcast side may hold.
BROADCAST_BYTES = 16 << 20


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `limit` rows and 16 MB of text and lists; else as it is, for a shuffled join.

    df is to be cheap to count: a written table, as a rule.
    """
    size = F.lit(0)
    for c, kind in df.dtypes:
        if kind in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(c), F.lit(0))
        elif kind == "array<bigint>":
            size = size + 8 * F.greatest(F.size(c), F.lit(0))
    got = df.select(size.alias("b")).limit(limit + 1).agg(F.count("*").alias("n"), F.sum("b").alias("b")).first()
    return F.broadcast(df) if got["n"] <= limit and (got["b"] or 0) <= BROADCAST_BYTES else df
