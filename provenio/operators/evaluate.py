"""Accuracy against gold labels, and what a change did."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenio.functions import text as T
from provenio.functions.exact import line_cer

# What a gold label says when there is nothing.
ABSENT = ("null", "false", "nao_prevista", "nao_excluido")


def gold_match(kind: Column, predicted: Column, accepted: Column) -> Column:
    """Whether a prediction, as text, is one of the accepted values; none predicted matches an accepted absence."""
    none = F.exists(accepted, lambda a: a.isNull() | a.isin(*ABSENT))
    plain = lambda x: F.lower(T.strip_accents(x))
    amount = F.exists(accepted, lambda a: F.abs(predicted.try_cast("double") - a.try_cast("double")) < 0.01)
    text = F.exists(accepted, lambda a: F.contains(plain(predicted), plain(a)))
    days = F.exists(accepted, lambda a: (predicted.try_cast("int") == a.try_cast("int")) | (predicted == a))
    same = F.array_contains(accepted, predicted)
    hit = F.when(kind == "dinheiro", amount | same).when(kind == "texto", text).when(kind == "duracao", days).otherwise(same)
    return F.coalesce(F.when(predicted.isNull(), none).otherwise(hit), F.lit(False))


def details(gold: DataFrame, facts: DataFrame) -> DataFrame:
    """gold (document, field_id, kind, accepted, ...) with the prediction that a reader would see, and whether it is right."""
    f = facts.select(F.col("doc_id").alias("document"), "field_id", "value", "status")
    out = gold.join(f, ["document", "field_id"], "left")
    predicted = F.when(F.col("status") == "verificado", F.col("value"))
    out = out.withColumn("predicted", predicted)
    hit = gold_match(F.col("kind"), F.col("predicted"), F.col("accepted"))
    wrong = F.coalesce(F.col("status") == "verificado", F.lit(False)) & ~hit
    return out.withColumn("status", F.coalesce("status", F.lit("sem_ficha"))).withColumn("hit", hit).withColumn("wrong_shown", wrong)


def metrics(details_: DataFrame, slices: list[list[str]]) -> DataFrame:
    """Accuracy of each slice: a list of the columns that a slice groups by, the empty list for all."""
    every = list(dict.fromkeys(c for s in slices for c in s))
    grouped = details_.groupingSets([[F.col(c) for c in s] for s in slices], *[F.col(c) for c in every])
    out = grouped.agg(F.grouping_id().alias("slice"), F.count("*").alias("fields"), F.count_if("hit").alias("hits"), F.count_if("wrong_shown").alias("wrong"))
    return out.withColumn("accuracy", F.bround(F.col("hits") / F.col("fields"), 4))


def changes(before: DataFrame, after: DataFrame, keys: tuple[str, ...] = ("document", "field_id")) -> DataFrame:
    """Rows whose hit or prediction changed."""
    a = before.select(*keys, F.col("predicted").alias("was"), F.col("hit").alias("was_hit"))
    b = after.select(*keys, F.col("predicted").alias("now"), F.col("hit").alias("now_hit"))
    return a.join(b, list(keys)).where(~F.col("was").eqNullSafe(F.col("now")) | ~F.col("was_hit").eqNullSafe(F.col("now_hit")))


def reading_errors(pages: DataFrame) -> DataFrame:
    """pages (document, page_no, reference, read) with their error rates, by line and of the whole page."""
    of_page = T.cer(F.coalesce("reference", F.lit("")), F.coalesce("read", F.lit("")))
    return pages.withColumn("cer", F.bround(line_cer(F.col("reference"), F.col("read")), 4)).withColumn("cer_page", F.bround(of_page, 4))


def reading_summary(errors: DataFrame) -> DataFrame:
    """One row (pages, cer_mean, cer_max)."""
    return errors.agg(F.count("*").alias("pages"), F.bround(F.avg("cer"), 4).alias("cer_mean"), F.max("cer").alias("cer_max"))
