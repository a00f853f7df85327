"""The queries of this subpackage: thin digests over its operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embedding_dedup, exact_dedup, html_text, packing, simhash, token_files, toxicity, url_filter, warc
from .common import new_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(_table(spark, sf_dir, "pages"), url_filter.host_of("url"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "token-files")
    token_files.save(_table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"), folder)
    return token_files.digest(spark, folder)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    got = toxicity.scored(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))
    return got.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("spans").alias("n_spans"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = simhash.groups(_table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decide(_table(spark, sf_dir, "documents"))



def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = _table(spark, sf_dir, "documents")
    return bpe.encoded(docs, _vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, digests=True)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pieces(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"))



def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "warc")
    warc.write(_table(spark, sf_dir, "pages"), folder)
    return warc.read(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")



def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.groups(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_text": op1_html_text,
    "op2_token_files": op2_token_files,
    "op3_toxicity": op3_toxicity,
    "op4_simhash": op4_simhash,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_url_filter": op7_url_filter,
    "op8_packing": op8_packing,
    "op9_warc": op9_warc,
    "op10_embedding_dedup": op10_embedding_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op9_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS hex FROM pages),
        q AS (
          SELECT page_id, h, min(page_id) OVER (PARTITION BY h) AS low,
                 list_transform(range(0, 8), lambda i: ('0x' || substr(hex, i * 5 + 1, 5))::INTEGER) AS v
          FROM p),
        d AS (
          SELECT page_id, strlen(h) AS payload_bytes, low,
                 array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v[k // 4 + 1] >> (15 - 5 * (k % 4))) & 31)::INTEGER + 1, 1)), '') AS payload_digest
          FROM q)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN low < page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN low < page_id THEN low END AS refers_to
        FROM d""",
    "op10_embedding_dedup": """
        WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE label IS NOT NULL),
        n AS (SELECT vec_id, label, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS len FROM e),
        l AS (
          SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id
          WHERE a.len > 0 AND b.len > 0 AND list_dot_product(a.v, b.v) / (a.len * b.len) >= 0.98),
        r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
        c AS (SELECT a, min(b) AS low FROM r GROUP BY a),
        d AS (SELECT a, count(*) AS k FROM l GROUP BY a)
        SELECT vec_id, coalesce(k, 0) AS n_links, least(coalesce(low, vec_id), vec_id) AS component_id,
               least(coalesce(low, vec_id), vec_id) = vec_id AS kept
        FROM embeddings LEFT JOIN c ON c.a = vec_id LEFT JOIN d ON d.a = vec_id""",
    "op5_exact_dedup": r"""
        WITH d AS (
          SELECT doc_id, coalesce(text, '') AS t,
                 sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h
          FROM documents),
        w AS (
          SELECT doc_id, h,
                 first_value(doc_id) OVER (PARTITION BY h ORDER BY length(t) DESC, doc_id) AS keep_id,
                 count(*) OVER (PARTITION BY h) AS group_size
          FROM d)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM w""",
}
