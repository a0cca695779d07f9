"""A Spark session with the settings the engine is written for."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "4194304",
}


def session(master: str | None = None, **more: str) -> SparkSession:
    """Get or create a session; more: further settings, with _ for the dots."""
    builder = SparkSession.builder.appName("provenio")
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **{k.replace("_", "."): v for k, v in more.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a local master gets one of its own; a cluster is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    own = os.path.join(tempfile.gettempdir(), f"provenio-checkpoints-{os.getpid()}")
    return f"file://{own}"


def staged(df: DataFrame) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again.

    This cuts the lineage: losing an executor afterwards costs no work done before,
    and what several later steps read is worked out once. The files stay until the
    owner of the shared folder clears it, as the result is read lazily.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
