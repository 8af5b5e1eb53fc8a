"""Mixing sources to target weights by hash-threshold histograms (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._work import WORD, keep, small

#: Hex digits of the hash that one histogram level resolves, and the number of levels: 16**9 thresholds.
DIGITS, LEVELS = 3, 3
_KEYS = ("_k1", "_k2", "_k3")


def word_count(text: Column) -> Column:
    """Number of words of a text column; null: 0."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), 0)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], max_epochs: float) -> DataFrame:
    """(source, source_size) -> the same with target: weighted shares of the whole, none above max_epochs times its source.

    Water filling in closed form. With the level x, a source gets min(cap, x * weight). Ordered by
    cap / weight, the first sources are those at their cap; x follows from the rest. One row a source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    one = sizes.withColumn("_w", w).withColumn("_cap", F.col("source_size") * F.lit(float(max_epochs)))
    fill = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    upto = fill.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy()
    one = (
        one.withColumn("_ratio", F.col("_cap") / F.col("_w"))
        .withColumn("_total", F.sum("source_size").over(whole))
        .withColumn("_capped", F.sum("_cap").over(upto) - F.col("_cap"))
        .withColumn("_left", F.sum("_w").over(whole) - F.sum("_w").over(upto) + F.col("_w"))
        .withColumn("_level", (F.col("_total") - F.col("_capped")) / F.col("_left"))
        .withColumn("_x", F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct(F.row_number().over(fill), "_level"))).over(whole)["_level"])
    )
    # The first source in that order whose level stays within its ratio gives x.
    return one.select("source", "source_size", F.least("_cap", F.coalesce(F.col("_x"), F.lit(float("inf"))) * F.col("_w")).alias("target"))


def _hash(doc_id: str, text: str) -> Column:
    """The hash that a row is taken by: hex digits of an md5 of doc_id and text."""
    return F.substring(F.md5(F.concat_ws(":", F.coalesce(F.col(doc_id).cast("string"), F.lit("-")), F.coalesce(F.col(text), F.lit("")))), 1, DIGITS * LEVELS)


def _rows(docs: DataFrame) -> DataFrame:
    hexed = _hash("doc_id", "text")
    keys = [F.substring(hexed, 1 + DIGITS * i, DIGITS).alias(k) for i, k in enumerate(_KEYS)]
    return keep(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), *keys), "mix_rows")


def _copies(h: Column, max_epochs: int) -> Column:
    """How often a row is taken: its source's full epochs, and once more below the source's threshold."""
    more = (h < F.col("_edge")) | ((h == F.col("_edge")) & F.col("_take"))
    return F.least(F.col("_full") + F.coalesce(more, F.lit(False)).cast("int"), F.lit(int(max_epochs))).cast("int")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), max_epochs: int = 3) -> DataFrame:
    """Number of copies of each document such that each source's words come near its target.

    docs has doc_id, text and source. Returns doc_id, source, size, source_size, target, copies and taken
    (size * copies), one row for each row of docs.

    A source with target t and size s takes every document floor(t / s) times, and once more those whose
    hash is below a threshold. The threshold is found by histograms of sizes over 4096 hash buckets; only
    the bucket in which the budget ends is refined, twice. The last leaf joins if that comes nearer to the
    budget, so a source misses its target by half a document as a rule. Nothing is sorted or sampled, and
    what is shuffled is (source, bucket) sums, combined before the shuffle.

    Null text has size 0; a null source is a source of its own, the last. The hash is of doc_id and text,
    so reruns agree; repeated rows share one hash and are taken alike. An empty table gives an empty result.
    Other columns are ignored.
    """
    rows = _rows(docs)
    out = rows.join(_limits(rows, weights, max_epochs), F.col("source").eqNullSafe(F.col("_s")))
    h = F.concat(*[F.col(k) for k in _KEYS])
    copies = _copies(h, max_epochs)
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).cast("long").alias("taken"), h.alias("hash"))


def _limits(rows: DataFrame, weights: tuple[float, ...], max_epochs: int) -> DataFrame:
    """A row a source: _s, source_size, target, _full (epochs), _edge (the leaf in which the budget ends) and _take (whether it joins)."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = source_targets(sizes, weights, max_epochs)
    s, t = F.col("source_size"), F.col("target")
    plan = plan.withColumn("_full", F.when(s > 0, F.floor(t / s)).otherwise(0).cast("int"))
    plan = small(keep(plan.withColumn("_budget", F.when(s > 0, t - F.col("_full") * s).otherwise(F.lit(0.0))), "mix_plan"))

    # Per source: the bucket in which the budget ends, and what lies before it.
    edges = plan.select(F.col("source").alias("_s"), "_budget", F.lit(0).cast("long").alias("_before"))
    for level, key in enumerate(_KEYS):
        known = list(_KEYS[:level])
        here = rows if not level else rows.alias("r").join(
            small(edges.select("_s", *[F.col(k).alias(f"_e{k}") for k in known])),
            F.col("r.source").eqNullSafe(F.col("_s")) & _all([F.col(f"r.{k}") == F.col(f"_e{k}") for k in known]),
        ).select("r.*")
        sums = here.groupBy("source", key).agg(F.sum("size").alias("_n"))
        upto = Window.partitionBy("source").orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        sums = sums.withColumn("_cum", F.sum("_n").over(upto))
        joined = sums.join(small(edges), F.col("source").eqNullSafe(F.col("_s")))
        before = F.col("_before") + F.col("_cum") - F.col("_n")
        last = F.max_by(F.struct(F.col(key), before.alias("b"), F.col("_n").alias("n")), key)
        edges = joined.where(before <= F.col("_budget")).groupBy("source").agg(
            last.alias("_at"), F.first("_budget").alias("_budget"), *[F.first(k).alias(k) for k in known]
        ).select(
            F.col("source").alias("_s"), "_budget", F.col("_at.b").alias("_before"), F.col("_at.n").alias("_leaf"), *known, F.col(f"_at.{key}").alias(key)
        )
        edges = keep(edges, f"mix_edges{level}")
    take_leaf = 2 * F.col("_before") + F.col("_leaf") <= 2 * F.col("_budget")
    edge = F.concat(*[F.col(k) for k in _KEYS])
    limits = edges.select("_s", edge.alias("_edge"), take_leaf.alias("_take"))
    return small(keep(plan.join(small(limits), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s").withColumnRenamed("source", "_s"), "mix_limits"))


def mixed(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), max_epochs: int = 3) -> DataFrame:
    """The rows of docs, each as often as mix() takes it (rows it does not take go; order is free). All columns pass through."""
    # Rows go through as one struct, so that no column of theirs can clash; what meets them is a row a source.
    packed = docs.select(F.struct("*").alias("_all"))
    out = packed.join(_limits(_rows(docs), weights, max_epochs), F.col("_all.source").eqNullSafe(F.col("_s")))
    out = out.select("_all", _copies(_hash("_all.doc_id", "_all.text"), max_epochs).alias("_n")).where("_n > 0")
    return out.select("_all", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_copy")).select("_all.*")


def _all(conditions: list):
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out
