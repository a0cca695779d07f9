"""One query for each corpus operator, over its whole table and with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenio.llm import dartminhash, extract, langid, lm, media, mixing, negatives, packing, quality, secrets, simhash, topk, whitening
from provenio.llm.common import crc_mod, only, table

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    filters = langid.train(docs.where(crc_mod("doc_id", 5) != 0))
    found = langid.identify(only(docs, "doc_id", "text"), filters)
    return found.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "language.*")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs.where(crc_mod("doc_id", 4) != 2), table(spark, sf_dir, "labels"))
    found = quality.scored(only(docs, "doc_id", "text"), model)
    return found.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op3_media_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media.copies(media.page_features(table(spark, sf_dir, "pages")))
    return found.select(F.col("id").alias("page_id"), "class_id", "n_corners")


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20, scale=64)


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = only(table(spark, sf_dir, "documents"), "doc_id", "text", "source")
    mixed = mixing.mix(docs, max_repeats=2.0)
    return mixed.select("doc_id", "source", "mix.n_tokens", "mix.epoch", "mix.block", F.round("mix.weight", 6).alias("weight"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), VOCABULARY)


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.page_texts(table(spark, sf_dir, "pages"))


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = only(table(spark, sf_dir, "documents"), "doc_id", "text")
    return secrets.digest(secrets.find_secrets(docs))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dartminhash.classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("is_representative"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scores(table(spark, sf_dir, "documents"), crc_mod("doc_id", 7) == 2)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = only(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(vectors, F.col("vec_id") % 100 == 0, label)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {f.__name__: f for f in (
    op1_language_id, op2_quality_classifier, op3_media_copies, op4_exact_top_k, op5_source_mixing, op6_best_fit_packing, op7_html_extraction, op8_secret_scans,
    op9_minhash_near_dedup, op10_lm_scoring, op11_hard_negatives, op12_embedding_whitening, op13_simhash_near_dedup,
)}
ORACLE_SQL: dict[str, str] = {
    "op11_hard_negatives": """
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), pairs AS (
            SELECT a.vec_id AS anchor_id, o.vec_id AS other_id, a.label = o.label AS same,
                   CAST(list_sum(list_transform(list_zip(a.e, o.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v a JOIN v o ON a.vec_id <> o.vec_id AND len(a.e) = len(o.e)
            WHERE a.vec_id % 100 = 0
        ), positives AS (
            SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM pairs WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
        ), ranked AS (
            SELECT p.anchor_id, positive_id, n.other_id AS negative_id, positive_score, n.score AS negative_score,
                   row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY n.score DESC, n.other_id) AS rank
            FROM positives p JOIN pairs n ON p.anchor_id = n.anchor_id AND NOT n.same
              AND 30 * positive_score <= 100 * n.score AND 100 * n.score <= 90 * positive_score
        )
        SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 10
    """,
    "op4_exact_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
            FROM embeddings
            WHERE vec_id IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), pairs AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                   CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
            WHERE q.vec_id % 20 = 0
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs
        )
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 20
    """,
    "op5_source_mixing": """
        WITH RECURSIVE d AS (
            SELECT doc_id, source, coalesce('=' || source, 'null') AS key,
                   CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+')) AS BIGINT) AS n,
                   CAST('0x' || substr(md5('0|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 7) AS BIGINT) AS place
            FROM documents
        ), b AS (SELECT key, place % 512 AS block, CAST(sum(n) AS BIGINT) AS s FROM d GROUP BY ALL),
        src AS (SELECT key, CAST(sum(s) AS BIGINT) AS tokens FROM b GROUP BY key),
        lim AS (
            SELECT min(tokens / (SELECT sum(tokens) FROM src)) AS lo, max(tokens / (SELECT sum(tokens) FROM src)) AS hi
            FROM src WHERE tokens > 0
        ), bis AS (
            SELECT 0 AS i, CAST(0 AS DOUBLE) AS a, CAST(1 AS DOUBLE) AS z
            UNION ALL
            SELECT i + 1, CASE WHEN ok THEN a ELSE m END, CASE WHEN ok THEN m ELSE z END FROM (
                SELECT i, a, z, (a + z) / 2 AS m, pow(lim.lo, (a + z) / 2 - 1) / pow(lim.hi, (a + z) / 2 - 1) <= 2 AS ok FROM bis, lim
            ) WHERE i < 60
        ), e AS (
            SELECT round(CASE WHEN pow(lim.lo, -1) / pow(lim.hi, -1) <= 2 THEN 0 ELSE (SELECT z FROM bis WHERE i = 60) END, 9) AS x FROM lim
        ), tot AS (
            SELECT sum(tokens) AS t, sum(CASE WHEN tokens > 0 THEN pow(tokens / (SELECT sum(tokens) FROM src), (SELECT x FROM e)) END) AS z FROM src
        ), w AS (
            SELECT key, tokens, CASE WHEN tokens > 0 THEN pow(tokens / t, x) / z ELSE 0 END AS weight,
                   t * z / pow(lim.hi, x - 1) AS budget
            FROM src, tot, e, lim
        ), p AS (
            SELECT *, CASE WHEN tokens > 0 THEN CAST(floor(weight * budget + 0.000001) AS BIGINT) ELSE 0 END AS part FROM w
        ), q AS (
            SELECT *, CASE WHEN tokens > 0 THEN part // tokens ELSE 1 END AS whole,
                   CASE WHEN tokens > 0 THEN part % tokens ELSE 0 END AS rest FROM p
        ), r AS (
            SELECT b.key, b.block, b.s, q.weight, q.whole,
                   q.rest - coalesce(sum(b.s) OVER (
                       PARTITION BY b.key
                       ORDER BY CAST('0x' || substr(md5('0|' || b.key || '|' || q.whole || '|' || b.block), 1, 7) AS BIGINT), b.block
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room
            FROM b JOIN q ON b.key = q.key
        ), t AS (
            SELECT d.*, r.block, r.weight, r.whole, r.s, r.room,
                   sum(d.n) OVER (PARTITION BY d.key, r.block ORDER BY d.place, d.n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS so_far
            FROM d JOIN r ON d.key = r.key AND d.place % 512 = r.block
        ), c AS (
            SELECT *, whole + CASE WHEN s <= room THEN 1 WHEN room > 0 AND so_far <= room THEN 1 ELSE 0 END AS times FROM t
        )
        SELECT doc_id, source, n AS n_tokens, CAST(epoch AS INTEGER) AS epoch, CAST(block AS INTEGER) AS block, round(weight, 6) AS weight
        FROM (SELECT *, unnest(range(CAST(times AS BIGINT))) AS epoch FROM c)
    """,
}
