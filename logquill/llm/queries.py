"""The registered queries opN_<name>; each reads its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logquill.llm import alignment, bpe, html_text, licenses, manifest, neardup, packing, png_media, quality, secrets, token_counts, token_store, topk


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op2_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"))


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.store_and_read(_table(spark, sf_dir, "documents"))


def op7_png_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return png_media.media_of_documents(_table(spark, sf_dir, "documents"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(_table(spark, sf_dir, "documents"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op11_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(_table(spark, sf_dir, "pages"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(_table(spark, sf_dir, "documents"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_documents(_table(spark, sf_dir, "documents"))


_ALL = (op1_best_fit_packing, op2_minhash_neardup, op3_token_counts, op4_exact_topk, op5_quality, op6_token_store, op7_png_media, op8_secrets, op9_bpe, op10_licenses, op11_html_text, op12_merkle_manifest, op13_alignment)
QUERIES = {f.__name__: f for f in _ALL}

#: Only these can be told in SQL without the learned, hashed or tokenised parts of the others.
ORACLE_SQL = {
    "op4_exact_topk": """
        WITH v AS (
            SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.row AS query_row, q.vec_id AS query_id, c.row, c.vec_id,
                   cast(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.row <> c.row AND q.vec_id % 50 = 0
        )
        SELECT query_id, cast(rank AS INTEGER) AS rank, vec_id, score FROM (
            SELECT *, row_number() OVER (PARTITION BY query_row ORDER BY score DESC, vec_id, row) AS rank FROM s
        ) WHERE rank <= 5
    """,
    "op12_merkle_manifest": """
        WITH RECURSIVE crc AS (
            SELECT *, row_number() OVER () AS row, xor(list_reduce(
                list_prepend(4294967295::UBIGINT, list_transform(string_split(cast(doc_id AS VARCHAR), ''), lambda c: ascii(c)::UBIGINT)),
                lambda crc, b: list_reduce(list_prepend(xor(crc, b), list_transform(range(8), lambda k: k::UBIGINT)), lambda x, k: xor(x >> 1, (x & 1) * 3988292384::UBIGINT))
            ), 4294967295::UBIGINT) % 3 = 0 AS chosen
            FROM documents
        ), told AS (
            SELECT row, doc_id, coalesce('=' || lang, '') AS g, coalesce(chosen, false) AS chosen,
                coalesce(strlen(cast(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
                    || coalesce(strlen(cast(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
                coalesce(strlen(text) || ':' || text, '-') AS text,
                coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-') AS small
            FROM crc
        ), leaves AS (
            SELECT row, doc_id, g, sha256(head || text) AS leaf, sha256(head || CASE WHEN chosen THEN small ELSE text END) AS given FROM told
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY g) AS n FROM leaves
        ), tree AS (
            SELECT 0 AS level, g, idx, leaf AS h, n FROM ranked
            UNION ALL
            SELECT level + 1, g, idx // 8, sha256(string_agg(h, '' ORDER BY idx)), (n + 7) // 8 FROM tree WHERE n > 1 GROUP BY level, g, idx // 8, n
        ), runs AS (
            SELECT level, g, idx // 8 AS run, list(h ORDER BY idx) AS hs FROM tree WHERE n > 1 GROUP BY level, g, idx // 8
        ), walk AS (
            SELECT row, g, 0 AS level, idx, given AS h, '' AS proof, n FROM ranked
            UNION ALL
            SELECT w.row, w.g, w.level + 1, w.idx // 8, sha256(list_aggregate(hs[:w.idx % 8] || [w.h] || hs[w.idx % 8 + 2:], 'string_agg', '')),
                w.proof || coalesce(list_aggregate(hs[:w.idx % 8] || hs[w.idx % 8 + 2:], 'string_agg', ''), ''), (w.n + 7) // 8
            FROM walk w JOIN runs r ON r.level = w.level AND r.g = w.g AND r.run = w.idx // 8
        ), subroots AS (
            SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS idx, count(*) OVER () AS n FROM tree WHERE n = 1
        ), top AS (
            SELECT 0 AS level, idx, subroot AS h, n FROM subroots
            UNION ALL
            SELECT level + 1, idx // 8, sha256(string_agg(h, '' ORDER BY idx)), (n + 7) // 8 FROM top WHERE n > 1 GROUP BY level, idx // 8, n
        ), top_runs AS (
            SELECT level, idx // 8 AS run, list(h ORDER BY idx) AS hs FROM top WHERE n > 1 GROUP BY level, idx // 8
        ), rise AS (
            SELECT w.row, s.subroot, 0 AS level, s.idx, w.h, w.proof, s.n FROM walk w JOIN subroots s ON s.g = w.g WHERE w.n = 1
            UNION ALL
            SELECT w.row, w.subroot, w.level + 1, w.idx // 8, sha256(list_aggregate(hs[:w.idx % 8] || [w.h] || hs[w.idx % 8 + 2:], 'string_agg', '')),
                w.proof || coalesce(list_aggregate(hs[:w.idx % 8] || hs[w.idx % 8 + 2:], 'string_agg', ''), ''), (w.n + 7) // 8
            FROM rise w JOIN top_runs r ON r.level = w.level AND r.run = w.idx // 8
        )
        SELECT l.doc_id, l.leaf, r.subroot, (SELECT h FROM top WHERE n = 1) AS root, sha256(r.proof) AS proof_sha256, r.h AS folded_root, r.h = (SELECT h FROM top WHERE n = 1) AS verified
        FROM leaves l JOIN rise r ON r.row = l.row AND r.n = 1
    """,
}
