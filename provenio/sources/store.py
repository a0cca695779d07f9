"""Results at rest: Parquet tables that documents are replaced and deleted in, traces, cached answers and reports."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from provenio.session import staged
from provenio.sources.files import keep_latest

#: Folders that a table of documents is dealt into; a replacement rewrites those that its documents are in.
BUCKETS = 64
ANSWERS = "key string, answer string"


def append(rows: DataFrame, path: str, *partitions: str) -> None:
    """Add rows to a table; readers take the latest of each key."""
    rows.write.mode("append").partitionBy(*partitions).parquet(path)


def latest(spark: SparkSession, path: str, keys: list[str], by: str = "created_at") -> DataFrame:
    return keep_latest(spark.read.parquet(path), keys, by)


def without_deleted(rows: DataFrame, deleted: DataFrame, key: str = "doc_id") -> DataFrame:
    """What is left of a dependent table when documents are deleted."""
    return rows.join(deleted.select(key), key, "left_anti")


def missing(wanted: DataFrame, stored: DataFrame, *keys: str) -> DataFrame:
    """What has still to be worked out: before costly functions, not after."""
    return wanted.join(stored.select(*keys).distinct(), list(keys), "left_anti")


def trace_tail(trace: DataFrame, n: int, order: str = "start_ts", tie: str = "run_id") -> DataFrame:
    return trace.orderBy(F.desc(order), tie).limit(n)


def details(json: Column) -> Column:
    """What a trace or a document carries besides its columns, as VARIANT; null where it isn't JSON."""
    return F.try_parse_json(json)


def detail(variant: Column, path: str, kind: str) -> Column:
    """The value at a path as a kind; null if it is missing or of another kind."""
    return F.try_variant_get(variant, path, kind)


def cache_key(system, user):
    """Key of a cached answer."""
    return F.substring(F.sha2(F.concat_ws("\0", system, user).cast("binary"), 256), 1, 32)


def known(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A table that need not be there yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def asking(provider: Callable[[], Callable[[str, str], str]]):
    """A table function (system, user) -> (answer) that sets up the provider once for each task."""

    class Ask:
        def __init__(self) -> None:
            self.own = provider()

        def eval(self, system: str, user: str) -> Iterator[tuple[str | None]]:
            yield (self.own(system, user),)

    return F.udtf(Ask, returnType="answer string")


def asked(prompts: DataFrame, provider: Callable[[], Callable[[str, str], str]]) -> DataFrame:
    """prompts (key, system, user) with what the provider says to each, by a lateral join with its table function."""
    said = asking(provider)(F.col("p_system").outer(), F.col("p_user").outer())  # `user` alone is a function there
    return prompts.select("key", F.col("system").alias("p_system"), F.col("user").alias("p_user")).lateralJoin(said).select("key", "answer")


def answered(prompts: DataFrame, cache: DataFrame, provider: Callable[[], Callable[[str, str], str]]) -> DataFrame:
    """prompts (prompt_id, system, user) with answers: cached ones by key, the rest from an injected provider, once for each key.

    Nothing is kept: each further action asks again. See answered_once.
    """
    keyed = prompts.withColumn("key", cache_key("system", "user"))
    todo = keyed.join(cache.select("key"), "key", "left_anti").dropDuplicates(["key"])
    new = asked(todo.select("key", "system", "user"), provider)
    return keyed.join(cache.select("key", "answer").unionByName(new), "key", "left").select("prompt_id", "key", "answer")


def answered_once(prompts: DataFrame, path: str, provider: Callable[[], Callable[[str, str], str]], wave: int = 10_000) -> DataFrame:
    """As answered, with the cache at a path: answers are written there before they are used, so that a key is asked once.

    Keys go in waves of about that many, each a commit of its own: a restart asks only what no finished wave has. Within a
    wave that fails, a task that is repeated asks again. A null prompt has no answer and isn't asked. Asks when it is called.
    """
    spark = prompts.sparkSession
    keyed = staged(prompts.withColumn("key", F.when(F.col("system").isNotNull() & F.col("user").isNotNull(), cache_key("system", "user"))))
    wanted = keyed.where("key is not null").select("key", "system", "user").dropDuplicates(["key"])
    todo = staged(missing(wanted, known(spark, path, ANSWERS), "key"))
    waves = -(-todo.count() // wave)
    for i in range(waves):
        asked(todo.where(F.pmod(F.xxhash64("key"), F.lit(waves)) == i), provider).write.mode("append").parquet(path)
    return keyed.join(known(spark, path, ANSWERS), "key", "left").select("prompt_id", "key", "answer")


def replace_documents(rows: DataFrame, path: str, deleted: DataFrame | None = None, key: str = "doc_id") -> None:
    """Put the rows of some documents in place of all that a table has of them, and take deleted documents (key) out.

    The table is dealt into folders by key; those that the documents are in are rewritten, the others stay as they are. A
    deleted document leaves a row that readers skip, so that a folder is never without rows. Doing it again changes nothing,
    and a writer that fails before the end has changed nothing.
    """
    spark = rows.sparkSession
    own = rows.withColumn("_deleted", F.lit(False))
    if deleted is not None:
        named = deleted.select(key).distinct().join(rows.select(key), key, "left_anti")
        own = own.unionByName(named.withColumn("_deleted", F.lit(True)), allowMissingColumns=True)
    own = staged(own.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")))
    buckets = [r[0] for r in own.select("_bucket").distinct().collect()]  # BUCKETS at most
    held = known(spark, path, own.schema).where(F.col("_bucket").isin(buckets))
    left = held.alias("held").join(own.select(key).distinct().alias("new"), F.col(f"held.{key}").eqNullSafe(F.col(f"new.{key}")), "left_anti")
    both = staged(own.unionByName(left.select(*own.columns)))
    both.repartition("_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(path)


def delete_documents(deleted: DataFrame, *paths: str, key: str = "doc_id") -> None:
    """Take documents (key) out of a table and of all that depend on it, dependent ones first."""
    spark = deleted.sparkSession
    for path in reversed(paths):
        schema = spark.read.parquet(path).drop("_deleted", "_bucket").schema
        replace_documents(spark.createDataFrame([], schema), path, deleted, key)


def documents(spark: SparkSession, path: str) -> DataFrame:
    """What a table of documents holds."""
    return spark.read.parquet(path).where(~F.col("_deleted")).drop("_deleted", "_bucket")


def report_rows(compared: DataFrame) -> DataFrame:
    """A comparison as Markdown lines (field_ord, line)."""
    cell = F.concat(F.lit("| "), "field_label", F.lit(" | "), "doc_label", F.lit(" | "), F.col("shown_text"), F.lit(" | "), "favourability", F.lit(" |"))
    return compared.select("field_ord", "doc_id", cell.alias("line"))


def write_report(compared: DataFrame, path: str, form: str = "json") -> None:
    """A report: json, or md as text files."""
    if form == "json":
        compared.write.mode("overwrite").json(path)
    else:
        report_rows(compared).orderBy("field_ord", "doc_id").select("line").write.mode("overwrite").text(path)
