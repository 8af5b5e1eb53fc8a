"""Exact top-k inner-product search by Fagin's threshold algorithm."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._work import keep

#: Numbers (rows times dimensions) of a block of candidates, and of a block of queries.
BLOCK, QUERIES = 1 << 19, 1 << 16
#: First depth of the lists; depths double.
FIRST = 4


def usable(v: Column) -> Column:
    """Neither null nor with a null or non-finite component."""
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def sorted_lists(v: np.ndarray) -> np.ndarray:
    """Row numbers by ascending value, one column a dimension."""
    return np.argsort(v, axis=0, kind="stable").astype(np.int32)


def threshold_topk(v: np.ndarray, order: np.ndarray, ids: np.ndarray, q: np.ndarray, qids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int, int]]:
    """Yield (query id, row ids, scores, depth, rows scored), the k best of each query; ties to smaller ids.

    A dimension's list is read from the top where the query is positive and from the bottom where it is negative,
    all lists to the same depth. Rows met for the first time are scored in full (random access). No other row scores
    more than the inner product of the query with the next value of each list; a query stops when its k-th score is
    above that bound, or when the lists have shown every row. Depths double.
    """
    n, d = v.shape
    if not n:
        return
    ranked = np.take_along_axis(v, order, axis=0)
    for one, own in zip(q, qids, strict=True):
        up, down = np.flatnonzero(one > 0), np.flatnonzero(one < 0)
        fresh, left = np.ones(n, bool), n
        best, at = np.zeros(0), np.zeros(0, np.int64)
        depth, scored = 0, 0
        while left:
            deeper = min(n, max(FIRST, 2 * depth))
            shown = np.zeros(n, bool)
            shown[order[n - deeper : n - depth, up]] = True
            shown[order[depth:deeper, down]] = True
            shown &= fresh
            # At the end of the lists also what no list has: all rows, for a query of zeros.
            new = np.flatnonzero(shown if deeper < n else fresh)
            fresh[new] = False
            left -= len(new)
            depth = deeper
            new = new[ids[new] != own]
            scored += len(new)
            best, at = np.concatenate([best, v[new] @ one]), np.concatenate([at, new])
            if len(best) > k:
                top = best >= np.partition(best, len(best) - k)[len(best) - k]
                best, at = best[top], at[top]
            if len(best) >= k and left and best.min() > one[up] @ ranked[n - 1 - depth, up] + one[down] @ ranked[depth, down]:
                break
        first = np.lexsort((ids[at], -best))[:k]
        yield int(own), ids[at[first]], best[first], depth, scored


def _matrix(table: pa.Table, d: int, scale: float) -> np.ndarray:
    flat = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in table.column("embedding").chunks])
    return np.floor(flat.astype(np.float64).reshape(table.num_rows, d) * scale)


def _block(scale: float, lists: bool):
    """A group of vectors as one row: ids, numbers, and the sorted lists of its dimensions."""

    def of(key: tuple, table: pa.Table) -> pa.Table:
        v = _matrix(table, key[0].as_py(), scale)
        out = {"_d": key[0], "_b": key[1], "ids": pa.array([table.column("vec_id").to_numpy().tobytes()], pa.binary()), "v": pa.array([v.tobytes()], pa.binary())}
        if lists:
            out["lists"] = pa.array([sorted_lists(v).tobytes()], pa.binary())
        return pa.table({c: x if isinstance(x, pa.Array) else pa.array([x.as_py()], pa.int32()) for c, x in out.items()})

    return of


def _meet(k: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, *raw in zip(batch.column("_d").to_pylist(), *(batch.column(c) for c in ("ids", "v", "lists", "qids", "q")), strict=True):
                ids, v, order, qids, q = (np.frombuffer(x.as_py(), t) for x, t in zip(raw, (np.int64, np.float64, np.int32, np.int64, np.float64), strict=True))
                v, order, q = v.reshape(len(ids), d), order.reshape(len(ids), d), q.reshape(len(qids), d)
                if d * np.abs(v).max(initial=0) * np.abs(q).max(initial=0) >= 2**53:
                    raise OverflowError("scores above 2**53")
                out = list(threshold_topk(v, order, ids, q, qids, k))
                n = [len(x[1]) for x in out]
                yield pa.RecordBatch.from_pydict({
                    "query_id": np.repeat(np.array([x[0] for x in out], np.int64), n),
                    "vec_id": np.concatenate([x[1] for x in out]),
                    "score": np.concatenate([x[2] for x in out]).astype(np.int64),
                    "depth": np.repeat(np.array([x[3] for x in out], np.int64), n),
                    "scored": np.repeat(np.array([x[4] for x in out], np.int64), n),
                })

    return of


def top_k(vectors: DataFrame, k: int = 20, query_every: int = 20, scale: float = 64.0) -> DataFrame:
    """The k best rows by inner product of floor(scale * x), for each row whose vec_id query_every divides.

    vectors has vec_id and embedding. Returns query_id, rank (from 1), vec_id, score, and how the search for that
    result went: depth (positions read of each list of the result's block) and scored (rows of that block that were
    scored). A row is never its own result, and ties go to the smaller vec_id.

    Candidates are dealt into blocks by a hash, and the sorted lists of a block are built once and written. Blocks of
    queries meet them in tasks of bounded memory, where every query runs the threshold algorithm; the best k of each
    block are ranked, with a partial top-k before the shuffle. Queries are copied to each block of candidates;
    candidates are shuffled once. Nothing is broadcast or collected.

    Rows with a null vec_id, a null vector or a null or non-finite component take no part. Rows that
    repeat a vec_id count once (the smallest vector). Vectors meet only vectors of their own length. Scores
    must be below 2**53. Fewer candidates than k: all of them. Empty table: empty result. Other columns are
    ignored.
    """
    base = vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    base = base.groupBy("vec_id").agg(F.min("embedding").alias("embedding")).withColumn("_d", F.size("embedding"))
    is_query = F.col("vec_id") % query_every == 0
    size = vectors.agg(F.count("*").alias("n"), F.count_if(is_query).alias("q"), F.max(F.size("embedding")).alias("d")).first()
    wide = max(size["d"] or 1, 1)
    n_c, n_q = (max(1, -(-size[n] * wide // most)) for n, most in (("n", BLOCK), ("q", QUERIES)))
    hashed = F.xxhash64("vec_id")
    blob = "_d int, _b int, ids binary, v binary"
    cands = base.withColumn("_b", F.pmod(hashed, F.lit(n_c)).cast("int")).groupBy("_d", "_b").applyInArrow(_block(scale, True), blob + ", lists binary")
    asks = base.where(is_query).withColumn("_b", F.pmod(hashed, F.lit(n_q)).cast("int")).groupBy("_d", "_b").applyInArrow(_block(scale, False), blob)
    asks = asks.select("_d", F.col("ids").alias("qids"), F.col("v").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(n_c - 1))).alias("_b"))
    found = asks.join(keep(cands, "topk_lists"), ["_d", "_b"]).mapInArrow(_meet(k), "query_id long, vec_id long, score long, depth long, scored long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "depth", "scored")
