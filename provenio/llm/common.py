"""Helpers that the corpus operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provenio.session import shared_dir, staged

__all__ = ["bucketed", "crc_mod", "only", "shared_dir", "staged", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read through Spark so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucketed(df: DataFrame, column: str) -> DataFrame:
    """Write df to the shared folder as Parquet bucketed by a column, one bucket for each shuffle partition, and read it again.

    What is grouped or joined by the column then isn't shuffled. The catalogue's entry goes at once; the files stay as in staged.
    """
    spark, name = df.sparkSession, f"staged_{uuid.uuid4().hex}"
    writer = df.write.format("parquet").option("compression", "zstd").option("path", f"{shared_dir(spark)}/{name}")
    writer.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), column).saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return out


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the id written as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def only(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns alone, so that further columns of any name cannot clash."""
    return df.select(*[F.col(f"`{c}`") for c in columns])
