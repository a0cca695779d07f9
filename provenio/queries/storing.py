"""Tables that documents are replaced in, answers asked once, pages through the data source, newest lessons, and variants."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenio.queries.base import query, table
from provenio.session import shared_dir
from provenio.sources import pages as P
from provenio.sources import store
from provenio.streaming import lessons as L


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("""SELECT o_orderkey AS doc_id, CAST(count(l_linenumber) AS BIGINT) AS n_lines, CASE WHEN o_orderkey % 3 = 0 THEN 'second' ELSE 'first' END AS batch
    FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND (o_orderkey % 3 <> 0 OR l_linenumber > 1) WHERE o_orderkey % 5 <> 0 GROUP BY ALL""")
def replaced_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents and their lines as what depends on them: a batch of all, one that replaces a third, twice, and a deletion of both."""
    docs, lines = _place(spark, "documents"), _place(spark, "lines")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"))
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), "l_linenumber")
    again = F.col("doc_id") % 3 == 0
    store.replace_documents(orders.withColumn("batch", F.lit("first")), docs)
    store.replace_documents(items, lines)
    for _ in range(2):
        store.replace_documents(orders.where(again).withColumn("batch", F.lit("second")), docs)
        store.replace_documents(items.where(again & (F.col("l_linenumber") > 1)), lines, orders.where(again))
    store.delete_documents(orders.where(F.col("doc_id") % 5 == 0), docs, lines)
    n = store.documents(spark, lines).groupBy("doc_id").agg(F.count("*").alias("n_lines"))
    return store.documents(spark, docs).join(n, "doc_id", "left").select("doc_id", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), "batch")


@query("""SELECT conv_id, turn, role || ':' || length(text) AS answer, (SELECT count(DISTINCT (role, text)) FROM conversations WHERE role IS NOT NULL AND text IS NOT NULL) AS n_kept FROM conversations""")
def answers_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as prompts to a provider behind the cache, asked in two actions: each text has one answer there."""
    place = _place(spark, "answers")
    prompts = table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("prompt_id"), F.col("role").alias("system"), F.col("text").alias("user"))
    provider = lambda: lambda system, user: f"{system}:{len(user)}"
    store.answered_once(prompts.where(F.col("prompt_id.turn") < 3), place, provider)
    got = store.answered_once(prompts, place, provider)
    kept = spark.read.parquet(place).agg(F.count("*").alias("n_kept"))
    return got.crossJoin(F.broadcast(kept)).select("prompt_id.*", "answer", "n_kept")  # one row


@query("SELECT page_id, CAST(length(html) AS BIGINT) AS n FROM pages")
def source_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages written as files of lines, and read as pages of files through the data source."""
    place = _place(spark, "files")
    line = F.concat_ws(" ", F.col("page_id").cast("string"), F.base64(F.coalesce("html", F.lit("")).cast("binary")))
    table(spark, sf_dir, "pages").select(F.regexp_replace(line, r"[\r\n]", "")).repartition(16).write.text(place)
    P.register(spark)
    read = spark.read.format("document_pages").option("path", place).option("files", "4").load()
    parts = F.split("text", " ")
    return read.select(parts[0].cast("long").alias("page_id"), F.char_length(F.unbase64(parts[1]).cast("string")).cast("long").alias("n"))


_LESSONS = "SELECT CAST(user_id AS VARCHAR) AS doc_id, event_type AS field_id, CAST(event_id AS VARCHAR) AS lesson_id, CAST(value AS VARCHAR) AS value, ts FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL AND ts IS NOT NULL"


@query(f"""SELECT doc_id, field_id, lesson_id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, field_id ORDER BY ts DESC, lesson_id DESC) AS n FROM ({_LESSONS})) WHERE n = 1""")
def newest_lessons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as lessons of a user's kinds: the newest of each."""
    events = table(spark, sf_dir, "events")
    lessons = events.select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("field_id"), F.col("event_id").alias("lesson_id"), "value", F.lit("").alias("quote"), F.lit(1).alias("page"), F.col("ts").alias("created_at"))
    return L.newest(lessons).select("doc_id", "field_id", "lesson_id")


@query("""SELECT event_type, count(*) AS n, CAST(sum(CASE WHEN event_id % 4 <> 1 AND event_id % 4 <> 2 THEN CAST(json_extract(props, '$.k') AS BIGINT) END) AS BIGINT) AS total,
    CAST(count(*) FILTER (event_id % 4 = 1) AS BIGINT) AS broken, CAST(count(*) FILTER (event_id % 4 = 2 AND props IS NOT NULL) AS BIGINT) AS other FROM events GROUP BY event_type""")
def trace_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What events carry as variants: a number read by its path, broken JSON as null, and a value of another kind as null."""
    props = F.when(F.col("event_id") % 4 == 1, F.lit("{broken")).when(F.col("event_id") % 4 == 2, F.concat(F.lit('{"k": "'), F.col("props").substr(1, 0), F.lit('x"}'))).otherwise(F.col("props"))
    v = store.details(props)
    rows = table(spark, sf_dir, "events").select("event_type", "event_id", v.alias("v"))
    number, text = store.detail(F.col("v"), "$.k", "bigint"), store.detail(F.col("v"), "$.k", "string")
    return rows.groupBy("event_type").agg(
        F.count("*").alias("n"), F.sum(number).alias("total"), F.count_if(F.col("v").isNull()).alias("broken"), F.count_if(text == "x").alias("other")
    )
