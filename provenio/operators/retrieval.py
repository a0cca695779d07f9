"""BM25 ranking of blocks and full-text search, as joins on terms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenio.functions import text as T

K1, B, FLOOR = 1.5, 0.75, 0.25
TITLE_WEIGHT = 3


def postings(blocks: DataFrame, terms: Column, key: str = "block_id", wanted: DataFrame | None = None) -> DataFrame:
    """Rows (key, term, tf, len) of an array of terms; only those in wanted (term) if given, before anything is grouped."""
    own = blocks.select(F.col(key), terms.alias("terms")).withColumn("len", F.size("terms")).where("len > 0")
    each = own.select(key, "len", F.explode("terms").alias("term"))
    if wanted is not None:
        each = each.join(wanted.select("term").distinct(), "term", "left_semi")
    return each.groupBy(key, "term").agg(F.count("*").alias("tf"), F.max("len").alias("len"))


def counted(docs: DataFrame, key: str, words: Column, keep: Callable[[Column], Column] | None = None, form: Callable[[Column], Column] | None = None) -> DataFrame:
    """Rows (key, term, tf, len) of an array of words; those that keep holds for, in a form. Documents without a term have no row.

    One pass over the texts, words as rows of generated code; the rows of a document stay in one task, so that its
    length costs no further shuffle.
    """
    each = docs.select(F.col(key), F.explode(words).alias("term"))
    each = each.where(keep(F.col("term"))) if keep else each
    each = each.withColumn("term", form(F.col("term"))) if form else each
    tf = each.repartition(key).groupBy(key, "term").agg(F.count("*").alias("tf"))
    return tf.withColumn("len", F.sum("tf").over(Window.partitionBy(key)))


def block_terms(title: Column, body: Column) -> Column:
    """A block's terms, those of the title TITLE_WEIGHT times."""
    return F.concat(F.flatten(F.array_repeat(T.tokens(title), TITLE_WEIGHT)), T.tokens(body))


def bm25(postings_: DataFrame, queries: DataFrame, k: int, n: int | Column, mean_len: Column | float, key: str = "block_id") -> DataFrame:
    """Rows (query_id, key, score, rank): the k best blocks with a score above 0 for queries (query_id, term), repeated terms count again.

    Inverse document frequencies are Okapi's ln((N - df + 0.5) / (df + 0.5)); one that isn't positive counts as FLOOR times ln 2.
    Only the terms of the queries are looked up.
    """
    asked = queries.groupBy("query_id", "term").agg(F.count("*").alias("times"))
    found = postings_.join(asked.select("term").distinct(), "term", "left_semi")
    df = found.groupBy("term").agg(F.count("*").alias("df"))
    total = n if isinstance(n, Column) else F.lit(n)
    raw = F.ln((total - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = df.withColumn("idf", F.when(raw > 0, raw).otherwise(FLOOR * F.ln(F.lit(2.0)))).select("term", "idf")
    avg = mean_len if isinstance(mean_len, Column) else F.lit(mean_len)
    part = F.col("times") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / avg))
    scored = found.join(idf, "term").join(asked, "term").groupBy("query_id", key).agg(F.sum(part).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), key)
    ranked = scored.where("score > 0").withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select("query_id", key, "score", "rank")


def corpus_size(postings_: DataFrame, key: str = "block_id") -> tuple[int, float]:
    """Number of blocks and their mean length: two numbers."""
    row = postings_.groupBy(key).agg(F.max("len").alias("len")).agg(F.count("*"), F.avg("len")).first()
    return row[0] or 0, row[1] or 1.0


def search_terms(text: Column, most: int = 12) -> Column:
    """Words of a search text: over two characters, at most `most`, nothing that a query language would read."""
    words = F.regexp_extract_all(T.canonical(text), F.lit("[a-z0-9]+"), F.lit(0))
    return F.slice(F.filter(words, lambda w: F.length(w) > 2), 1, most)


def plain_words(text: Column) -> Column:
    return T.plain_words(text)


def field_query(label: Column, clues: Column, spec_labels: Column, taught: Column | None = None) -> Column:
    """What a declared field is searched by: its label, clues, labels in specifications, and quotes that were taught."""
    parts = [label, F.array_join(clues, " "), F.array_join(spec_labels, " ")]
    return F.concat_ws(" ", *parts, *([] if taught is None else [taught]))


def passages(ranked: DataFrame, blocks: DataFrame, key: str = "block_id", most: int = 3, chars: int = 400) -> DataFrame:
    """The answer without a model: the best blocks' texts after their marks."""
    text = F.regexp_replace("text", r"^([^\n]*\n){0,2}", "")
    out = ranked.where(F.col("rank") <= most).join(blocks, key)
    return out.select("query_id", "rank", key, F.substring(text, 1, chars).alias("quote"))


def of_documents(ranked: DataFrame, documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """A ranking within some documents: those of a table, of any size, by a join before the ranking is cut."""
    return ranked.join(documents.select(key).distinct(), key, "left_semi")


def snippet(text: Column, terms: Column, words: int = 18, open_: str = "[", close: str = "]", gap: str = " … ") -> Column:
    """The `words` words with most of the search's different terms in them, each hit marked, with a gap where the text goes on.

    The earliest of equal places counts, and it begins at a hit; a text without a hit gives its beginning.
    """
    every = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")
    found = F.transform(every, lambda w: F.array_intersect(plain_words(w), terms))
    at = F.filter(F.transform(found, lambda f, i: F.when(F.size(f) > 0, i)), lambda i: i.isNotNull())
    place = lambda i: F.struct((-F.size(F.array_distinct(F.flatten(F.slice(found, i + 1, words))))).alias("n"), i.alias("i"))
    start = F.coalesce(F.array_min(F.transform(at, place))["i"], F.lit(0))
    shown = F.transform(F.slice(every, start + 1, words), lambda w: F.when(F.size(F.array_intersect(plain_words(w), terms)) > 0, F.concat(F.lit(open_), w, F.lit(close))).otherwise(w))
    before, after = F.when(start > 0, gap).otherwise(""), F.when(start + words < F.size(every), gap).otherwise("")
    return F.concat(before, F.array_join(shown, " "), after)


def within_documents(postings_: DataFrame, sizes: DataFrame, queries: DataFrame, k: int, key: str = "block_id") -> DataFrame:
    """BM25 where each document is an index of its own.

    postings_ (doc_id, key, term, tf, len); sizes (doc_id, n, mean_len) of its blocks; queries (doc_id, query_id, term).
    Rows (doc_id, query_id, key, score, rank).
    """
    asked = queries.groupBy("doc_id", "query_id", "term").agg(F.count("*").alias("times"))
    found = postings_.join(asked.select("doc_id", "term").distinct(), ["doc_id", "term"], "left_semi")
    df = found.groupBy("doc_id", "term").agg(F.count("*").alias("df")).join(sizes, "doc_id")
    raw = F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = df.withColumn("idf", F.when(raw > 0, raw).otherwise(FLOOR * F.ln(F.lit(2.0)))).select("doc_id", "term", "idf", "mean_len")
    part = F.col("times") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean_len")))
    scored = found.join(idf, ["doc_id", "term"]).join(asked, ["doc_id", "term"]).groupBy("doc_id", "query_id", key).agg(F.sum(part).alias("score"))
    order = Window.partitionBy("doc_id", "query_id").orderBy(F.desc(F.round("score", 9)), key)
    return scored.where("score > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def best_of_each(rows: DataFrame, key: str, most: int, *order: Column) -> DataFrame:
    """Of each key the first rows in order, `nth` from 1; Spark cuts each task's rows to them before the shuffle."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("nth") <= most)
