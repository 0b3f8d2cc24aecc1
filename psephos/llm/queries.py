"""One query for each operator, over its whole table, with the digest columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from psephos.llm import decontam, embed_dedup, jaccard_join, langid, licenses, packing, quotes, resharding, suffix_dedup, toxicity

Query = Callable[[SparkSession, str], DataFrame]

SHARDS = 40


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_read(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.digest(decontam.scan(docs, _read(spark, sf_dir, "benchmark")))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_read(spark, sf_dir, "documents")).drop("detections")


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(_read(spark, sf_dir, "documents"), k=3, percent=90)


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(_read(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.detect(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf_dir, "documents"))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.join(_read(spark, sf_dir, "embeddings"))


def op9_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From shards by source, uneven as sources are, to 40 shards of near-equal bytes."""
    docs = _read(spark, sf_dir, "documents")
    old = F.pmod(F.crc32(F.col("source").cast("binary")), F.lit(SHARDS))
    out = resharding.reshard(docs, old, SHARDS, SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")


def op10_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.link(_read(spark, sf_dir, "conversations"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_language_id, op2_decontamination, op3_license_scan, op4_ngram_jaccard_join, op5_suffix_array_dedup, op6_toxicity, op7_best_fit_packing, op8_embedding_near_dedup, op9_resharding, op10_quotation_linking)}


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_TOKENS = rf"regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+')"
#: From links (x, y), both ways round, to the smallest node that each reaches.
_REACH = "r AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM r JOIN links l ON r.y = l.x), c AS (SELECT x, least(x, min(y)) AS component_id FROM r GROUP BY x), k AS (SELECT x, count(*) AS n_links FROM links GROUP BY x)"


def oracle_sql() -> dict[str, str]:
    """The queries that SQL can express, over whole tables; ids are taken to be unique."""
    decontamination = f"""
    WITH w AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
    i AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[p:p + 9], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM w WHERE len(w) > 0) x),
    d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
    s AS (SELECT DISTINCT n FROM i),
    g AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, s WHERE len(w) >= n) x),
    h AS (SELECT doc_id, i.n, p, item_id FROM g JOIN i USING (n, g)),
    hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT doc_id, n, p FROM h) y) z GROUP BY 1),
    it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h WHERE item_id IS NOT NULL) y GROUP BY 1)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)"""
    jaccard = f"""
    WITH RECURSIVE d AS (SELECT doc_id, {_TOKENS} AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS p FROM d WHERE len(w) > 0) x),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
    o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
    links AS (SELECT x, y FROM o JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 90 * (a.n + b.n - i)),
    {_REACH}
    SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.x = d.doc_id LEFT JOIN k ON k.x = d.doc_id"""
    embeddings = f"""
    WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
    links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
    {_REACH}
    SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, coalesce(component_id, vec_id) AS component_id, coalesce(component_id, vec_id) = vec_id AS kept FROM embeddings LEFT JOIN c ON c.x = vec_id LEFT JOIN k ON k.x = vec_id"""
    return {"op2_decontamination": decontamination, "op4_ngram_jaccard_join": jaccard, "op8_embedding_near_dedup": embeddings}
