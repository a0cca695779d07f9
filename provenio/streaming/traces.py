"""Streams: new documents once each, and metrics of a trace, with bounded state.

The batch form and the stream form are one function: what is a DataFrame of a stream
may be given wherever a table may.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from provenio.sources.files import identity, refusal, safe_name, short_id


def file_stream(spark: SparkSession, path: str, form: str, schema: StructType) -> DataFrame:
    """Files as they arrive below a path."""
    return spark.readStream.format(form).schema(schema).load(path)


def hourly(trace: DataFrame, late: str | None = None, time: str = "ts", kind: str = "event_type", value: str = "value") -> DataFrame:
    """Rows (kind, hour, n, total); late: how long after its hour a row of a stream still counts."""
    rows = trace.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) if late else trace
    grouped = rows.groupBy(F.window(time, "1 hour").alias("w"), kind).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return grouped.select(kind, F.col("w.start").alias("hour"), "n", "total")


def accepted_once(files: DataFrame, time: str = "arrived_at", within: str = "1 day") -> DataFrame:
    """Files (name, content, time) of a stream that intake accepts, each content once within the watermark."""
    known = files.withWatermark(time, within).where(refusal(F.col("content")).isNull()).withColumn("sha256", identity(F.col("content")))
    once = known.dropDuplicatesWithinWatermark(["sha256"])
    return once.select(short_id(F.col("sha256")).alias("doc_id"), safe_name(F.col("name")).alias("name"), "sha256", "content", time)


def append_stream(rows: DataFrame, path: str, checkpoint: str):
    """Start appending a stream to a table, exactly once."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()
