"""A corpus pipeline: quality, near duplicates, repeated passages, source weights, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as
the docs of the next. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspan.llm import _work
from fieldspan.llm.jaccard_join import without_copies
from fieldspan.llm.mixing import mixed
from fieldspan.llm.packing import best_fit
from fieldspan.llm.quality import with_quality
from fieldspan.llm.substring import substring_dedup

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _stage(operator):
    """Tables that the stage before has written are no longer read once its result is: they go first."""

    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _work.drop_scope(spark, "pipeline")
        _work.short_batches(spark)
        with _work.scope("pipeline"):
            return operator(spark, docs.select(*COLUMNS), sf_dir)

    return stage


@_stage
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return with_quality(docs, labels).where("quality_view.keep").select(*COLUMNS)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of smallest doc_id; repeated rows are one document. Rows without a doc_id or a text stay."""
    return without_copies(docs)


@_stage
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that earlier ones have; those that lose all their words go."""
    cut = substring_dedup(docs, carry=list(COLUMNS))
    changed = F.col("kept_text").isNotNull()
    text = F.when(changed, F.col("kept_text")).otherwise(F.col("text"))
    size = F.when(changed, F.char_length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    left = cut.where("kept_text is null or kept_text <> ''")
    return left.select("doc_id", text.alias("text"), "lang", "source", size.alias("n_chars"))


@_stage
def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixed(docs)


@_stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents in training sequences."""
    return best_fit(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("source_mixing", source_mixing),
    ("packing", packing),
]

#: No SQL expresses the trained classifier and the packing; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        path = _work.fresh_path(spark, f"stage_{name}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
