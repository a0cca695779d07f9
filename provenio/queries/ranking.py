"""BM25, full-text search, budgets and top-k within groups."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenio.functions import text as T
from provenio.operators import matching as M
from provenio.operators import retrieval as R
from provenio.queries.base import canonical_sql, query, table, tokens_sql
from provenio.session import shared_dir, staged
from provenio.sources.index import TextIndex


def _bm25_sql(terms: str, asked: str, k: int, extra: str = "") -> str:
    return f"""d AS (SELECT doc_id, {terms} AS t FROM documents), l AS (SELECT doc_id, t, len(t) AS n FROM d WHERE len(t) > 0),
    p AS (SELECT doc_id, n, unnest(t) AS term FROM l), tf AS (SELECT doc_id, term, n, count(*) AS tf FROM p GROUP BY ALL),
    s AS (SELECT count(*) AS total, avg(n) AS mean FROM l),
    q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({asked}) AS term FROM benchmark) GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM tf WHERE term IN (SELECT term FROM q) GROUP BY term),
    idf AS (SELECT term, CASE WHEN ln((total - df + 0.5) / (df + 0.5)) > 0 THEN ln((total - df + 0.5) / (df + 0.5)) ELSE 0.25 * ln(2.0) END AS w FROM df, s),
    r AS (SELECT q.item_id, tf.doc_id, sum(q.times * idf.w * tf.tf * 2.5 / (tf.tf + 1.5 * (0.25 + 0.75 * tf.n / s.mean))) AS score
          FROM tf JOIN q ON q.term = tf.term JOIN idf ON idf.term = tf.term, s GROUP BY ALL),
    o AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM r WHERE score > 0)
    SELECT item_id, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM o WHERE rank <= {k}"""


def _ranked(spark: SparkSession, sf_dir: str, counts: DataFrame, asked, k: int) -> DataFrame:
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(asked).alias("term"))
    counts = staged(counts)  # texts are taken apart once
    n, mean = R.corpus_size(counts, "doc_id")
    found = R.bm25(counts, queries, k, n, mean, "doc_id")
    return found.select(F.col("query_id").alias("item_id"), "doc_id", F.round("score", 6).alias("score"), "rank")


def _stems(docs: DataFrame) -> DataFrame:
    return R.counted(docs, "doc_id", T.plain_words(F.col("text")), T.is_term, T.stem)


@query("WITH " + _bm25_sql(tokens_sql("text"), tokens_sql("text"), 6))
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir, _stems(table(spark, sf_dir, "documents")), T.tokens(F.col("text")), 6)


@query("WITH " + _bm25_sql(tokens_sql("text"), tokens_sql("text"), 6))
def index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As bm25_topk, by an inverted index that the documents are added to in two batches, one of them repeated."""
    index = TextIndex(spark, f"{shared_dir(spark)}/index-{uuid.uuid4().hex}")
    docs = table(spark, sf_dir, "documents")
    for batch in (0, 1, 1):
        index.append(_stems(docs.where(F.coalesce(F.pmod("doc_id", F.lit(2)), F.lit(0)) == batch)).withColumnRenamed("doc_id", "key"), f"batch-{batch}")
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(T.tokens(F.col("text"))).alias("term"))
    return index.search(asked, 6).select(F.col("query_id").alias("item_id"), F.col("key").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


_FTS = f"list_filter(regexp_extract_all({canonical_sql('text')}, '[a-z0-9]+'), lambda w: length(w) > 2)[1:12]"


@query("WITH " + _bm25_sql(f"regexp_extract_all({canonical_sql('text')}, '[a-z0-9]+')", _FTS, 8))
def fts_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = R.counted(table(spark, sf_dir, "documents"), "doc_id", R.plain_words(F.col("text")))
    return _ranked(spark, sf_dir, counts, R.search_terms(F.col("text")), 8)


@query("""WITH c AS (SELECT l_orderkey AS key, list(CAST(floor(l_extendedprice) AS BIGINT) ORDER BY l_linenumber, floor(l_extendedprice)) AS n FROM lineitem GROUP BY 1)
    SELECT key, CAST(r // 1000 AS BIGINT) AS total, CAST(r % 1000 AS INTEGER) AS n_chosen FROM (
        SELECT key, list_reduce(list_prepend(CAST(0 AS BIGINT), n), lambda a, x: CASE WHEN a // 1000 + x <= 60000 THEN a + x * 1000 + 1 ELSE a END) AS r FROM c)""")
def budget_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), "l_linenumber", F.floor("l_extendedprice").cast("long").alias("n"))
    return M.select_within_budget(rows, "key", "l_linenumber", "n", 60_000).select("key", "total", F.size("chosen").alias("n_chosen"))


@query("""SELECT doc_id, source, n_chars FROM (SELECT doc_id, source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS n FROM documents) WHERE n <= 2""")
def topk_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.best_of_each(table(spark, sf_dir, "documents"), "source", 2, F.desc("n_chars"), F.col("doc_id")).select("doc_id", "source", "n_chars")


@query(rf"""SELECT doc_id, substr(regexp_replace(text, '^([^\n]*\n){{0,2}}', ''), 1, 400) AS quote FROM documents WHERE text IS NOT NULL AND doc_id IN (SELECT doc_id FROM labels)""")
def keyless_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text is not null")
    ranked = table(spark, sf_dir, "labels").select(F.lit(1).alias("query_id"), "doc_id", F.lit(1).alias("rank")).distinct()
    return R.passages(ranked, docs.select("doc_id", "text"), "doc_id").select("doc_id", "quote")


@query("""SELECT p_partkey, p_name || ' ' || p_brand || ' ' || p_type AS words FROM part""")
def field_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.select("p_partkey", R.field_query(F.col("p_name"), F.array("p_brand"), F.array("p_type")).alias("words"))
