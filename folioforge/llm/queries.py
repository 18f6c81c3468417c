"""The contract queries of the ten operators, and the SQL that checks them where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm import embeddings, langid, lm, packing, quality, secrets, simhash, simple8b
from folioforge.llm.decontaminate import find_leaks
from folioforge.llm.urls import judge_urls

RULES = "SELECT * FROM VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'block'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block') AS t(host, path, verdict)"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def packed_digests(docs: DataFrame) -> DataFrame:
    """The contract's columns of packed documents. Checksums are taken of the written pieces, so that ids need not follow them to their sequences."""
    pieces = packing.cut_pieces(docs, vocabulary("word_bpe_49k.json")).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.place(pieces).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op1_embedding_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_digests(_table(spark, sf_dir, "documents"))


def op5_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = simple8b.write_ids(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return simple8b.read_ids(files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents")).drop("value")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op8_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_table(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(_table(spark, sf_dir, "pages"), spark.sql(RULES))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_embedding_near_dup, op2_decontaminate, op3_quality, op4_pack, op5_token_ids, op6_secrets, op7_simhash, op8_hmm, op9_url_filter, op10_language)}

ORACLE_SQL = {
    "op2_decontaminate": r"""
        WITH d0 AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
        i0 AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark),
        widths AS (SELECT DISTINCT least(len(w), 5) AS k FROM i0 WHERE len(w) > 0 UNION SELECT 5),
        d AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i+k-1], ' '))) AS s FROM d0, widths WHERE len(w) >= k),
        i AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i+4], ' '))) AS s FROM i0 WHERE len(w) > 0),
        q AS (SELECT item_id, count(*) AS n FROM i GROUP BY item_id)
        SELECT d.doc_id, i.item_id, CAST(max(q.n) AS INTEGER) AS n_shingles, CAST(count(*) AS INTEGER) AS n_shared,
               count(*)::DOUBLE / max(q.n) AS containment
        FROM d JOIN i USING (s) JOIN q USING (item_id)
        GROUP BY d.doc_id, i.item_id HAVING count(*) >= ceil(0.8 * max(q.n) - 1e-9)""",
    "op9_url_filter": r"""
        WITH p AS (SELECT page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                          coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
        r(rh, rp, v) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'block'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
        m AS (SELECT p.*, rh || rp AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC NULLS LAST) AS k
              FROM p LEFT JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
        SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM m WHERE k = 1""",
}
