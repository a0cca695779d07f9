"""The corpus pipeline: the stages in order, each over all that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from provenio.llm import dartminhash, langid, mixing, packing, secrets
from provenio.llm.common import crc_mod, only, staged, table
from provenio.llm.queries import VOCABULARY

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A text goes if its best language contains less than this part of its trigrams; clean texts have 0.6 and more.
LEAST_COVERAGE = 0.2
MAX_REPEATS = 2.0
#: Bytes of texts that go to a Python worker at once; rows alone don't bound them, and workers keep what they once took.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter, null texts, and texts that no known language covers go."""
    spark.conf.set(*BATCH)
    filters = langid.train(docs.where(crc_mod("doc_id", 5) != 0))
    found = langid.identify(only(docs, *COLUMNS), filters)
    sure = (F.col("language.lang_pred") != "und") & (F.col("language.coverage") >= LEAST_COVERAGE)
    return found.where(sure).select(*COLUMNS)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the smallest id stays; rows that repeat it go too."""
    spark.conf.set(*BATCH)
    kept = staged(dartminhash.classes(docs)).where("first").select(dartminhash.keyed(F.col("doc_id"), F.col("node")).alias("name")).distinct()
    node = F.unhex(F.md5(F.col("text").cast("binary")))
    named = only(docs, *COLUMNS).withColumn("name", dartminhash.keyed(F.col("doc_id").cast("long"), node))
    once = Window.partitionBy("name").orderBy("n_chars")  # rows of one id and text
    stay = named.join(kept, "name", "left_semi").withColumn("nth", F.row_number().over(once))
    return stay.where("nth = 1").select(*COLUMNS)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts the secrets out of the texts; n_chars follows where a text changed, and every document stays."""
    spark.conf.set(*BATCH)
    before = only(docs, *COLUMNS).withColumn("was", F.col("text"))
    after = secrets.redact(before, "text")
    n = F.when(F.col("text").eqNullSafe(F.col("was")), F.col("n_chars")).otherwise(F.char_length("text").cast("long"))
    return after.withColumn("n_chars", n).select(*COLUMNS)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources drawn to tempered weights: every document once at least, those of small sources up to twice."""
    return mixing.mix(only(docs, *COLUMNS), max_repeats=MAX_REPEATS).select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, as often as they were drawn, with their sequences."""
    spark.conf.set(*BATCH)
    return packing.pack(docs, VOCABULARY)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("minhash_near_dedup", minhash_near_dedup),
    ("secret_scans", secret_scans),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: Trained models, hashed signatures and a tokenizer are not SQL; tests/llm holds run() against brute force instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
