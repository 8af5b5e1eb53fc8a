"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .cws import fingerprints
from .jaccard_join import jaccard_join
from .langid import predict_language
from .licenses import license_scan
from .mixing import mix
from .packing import best_fit
from .quality import with_quality
from .substring import substring_dedup
from .topk import top_k
from .warc import warc_round_trip


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(_table(spark, sf_dir, "embeddings")).select("query_id", "rank", "vec_id", "score")


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "text_id", "n_links")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = with_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "quality_view.*")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict_language(_table(spark, sf_dir, "documents"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(_table(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit(_table(spark, sf_dir, "documents"))


def op8_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(_table(spark, sf_dir, "pages"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_exact_top_k, op2_jaccard_join, op3_quality_classifier, op4_substring_dedup, op5_language_id,
        op6_fingerprints, op7_best_fit_packing, op8_warc_revisits, op9_license_scan, op10_mixing, pipeline,
    )
}

ORACLE_SQL = {
    "op1_exact_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
        )
        SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s
        QUALIFY rank <= 20""",
    "op4_substring_dedup": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), win AS (
            SELECT doc_id, p, array_to_string(list_slice(w, p, p + 49), ' ') AS s
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM d WHERE len(w) >= 50)
        ), hit AS (
            SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY s) AS f FROM win) WHERE f < doc_id
        ), gone AS (
            SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS k FROM hit
        ), g AS (SELECT doc_id, list(k) AS ks FROM gone GROUP BY doc_id),
        kept AS (
            SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(len(g.ks), 0)::BIGINT AS n_removed,
                   CASE WHEN g.ks IS NULL THEN array_to_string(d.w, ' ')
                        ELSE coalesce(array_to_string(list_filter(d.w, lambda x, i: NOT list_contains(g.ks, i)), ' '), '') END AS t
            FROM d LEFT JOIN g ON d.doc_id = g.doc_id
        )
        SELECT doc_id, n_words, n_removed, sha256(t) AS kept_sha256 FROM kept""",
    "op8_warc_revisits": """
        WITH p AS (
            SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(encode(coalesce(html, ''))) AS h FROM pages
        ), b AS (
            SELECT *, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                ((('0x' || substr(h, (5 * (i // 4) + 1)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31) + 1, 1)), '') AS payload_digest,
                max(page_id) OVER (PARTITION BY h) AS o FROM p
        )
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < o THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id < o THEN o END AS refers_to FROM b""",
    "op10_mixing": r"""
        WITH d AS (
            SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                   substr(md5(coalesce(doc_id::VARCHAR, '-') || ':' || coalesce(text, '')), 1, 9) AS h FROM documents
        ), s AS (
            SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
        ), w AS (
            SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS wt,
                   source_size * 3.0::DOUBLE AS cap FROM s
        ), r AS (
            SELECT *, row_number() OVER o AS rn, cap / wt AS ratio,
                   ((sum(source_size) OVER ())::DOUBLE - (sum(cap) OVER o - cap)) / (sum(wt) OVER () - sum(wt) OVER o + wt) AS lev
            FROM w WINDOW o AS (ORDER BY cap / wt, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
        ), x AS (
            SELECT arg_min(lev, rn) AS lev FROM r WHERE lev <= ratio
        ), t AS (
            SELECT source, source_size, least(cap, coalesce(x.lev, 'inf'::DOUBLE) * wt) AS target FROM r LEFT JOIN x ON true
        ), f AS (
            SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS fl FROM t
        ), c AS (
            SELECT d.*, f.source_size, f.target, f.fl, CASE WHEN f.source_size > 0 THEN f.target - f.fl * f.source_size ELSE 0 END AS budget,
                   sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h RANGE UNBOUNDED PRECEDING) AS cum,
                   sum(d.size) OVER (PARTITION BY d.source, d.h) AS leaf
            FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source
        )
        SELECT doc_id, size, source_size, target,
               (size * least(3, fl + CASE WHEN 2 * (cum - leaf) + leaf <= 2 * budget THEN 1 ELSE 0 END))::BIGINT AS taken FROM c""",
}
