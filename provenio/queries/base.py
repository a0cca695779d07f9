"""What the queries share: tables, derived lines and pages, and pieces of SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenio.functions import text as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
#: Documents have no pages of their own: so many lines make one.
PAGE_LINES = 10


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (doc_id, line_no, page_no, raw) of documents; PAGE_LINES lines make a page."""
    docs = table(spark, sf_dir, "documents")
    lines = docs.select("doc_id", F.posexplode(T.split_lines(F.coalesce("text", F.lit("")))).alias("line_no", "raw"))
    return lines.withColumn("page_no", (F.floor(F.col("line_no") / PAGE_LINES) + 1).cast("int"))


def document_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (doc_id, page_no, text)."""
    lines = document_lines(spark, sf_dir)
    pages = lines.groupBy("doc_id", "page_no").agg(F.sort_array(F.collect_list(F.struct("line_no", "raw"))).alias("l"))
    return pages.select("doc_id", "page_no", F.array_join(F.transform("l", lambda x: x["raw"]), "\n").alias("text"))


LINES = r"""lines AS (
    SELECT doc_id, CAST(i - 1 AS INTEGER) AS line_no, CAST((i - 1) // 10 + 1 AS INTEGER) AS page_no, l[i] AS raw
    FROM (SELECT doc_id, string_split_regex(coalesce(text, ''), '\r\n|\r|\n') AS l FROM documents), unnest(range(1, len(l) + 1)) AS u(i)
)"""


def canonical_sql(x: str) -> str:
    """The canonical form in SQL, for texts whose compatibility forms are Latin."""
    s = f"coalesce({x}, '')"
    s = rf"regexp_replace({s}, '([\p{{L}}\p{{N}}_])-\s*\n\s*([\p{{L}}\p{{N}}_])', '\1\2', 'g')"
    s = f"replace(translate({s}, '“”‘’–—ºª°', '\"\"''''--oao'), chr(173), '')"
    s = f"lower(strip_accents({s}))"
    s = rf"regexp_replace({s}, '[^\p{{L}}\p{{N}}_%$/.,;:()\"''\-]+', ' ', 'g')"
    return rf"trim(regexp_replace({s}, '\s+', ' ', 'g'))"


def tokens_sql(x: str) -> str:
    stop = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
    words = f"regexp_extract_all({canonical_sql(x)}, '[a-z0-9]+')"
    return f"list_transform(list_filter({words}, lambda w: length(w) > 1 AND NOT list_contains([{stop}], w)), lambda w: substr(w, 1, 6))"
