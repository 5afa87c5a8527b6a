"""Continuous ingestion of daily files: what the polling load does, as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def daily_stream(spark: SparkSession, path: str, schema: str, *, files: int = 1000) -> DataFrame:
    """New Parquet files of a folder, at most ``files`` a batch, a first row for each (date, code) seen within a week."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    return rows.withColumn("_at", rows["date"].cast("timestamp")).withWatermark("_at", "7 days").dropDuplicatesWithinWatermark(["date", "code"]).drop("_at")


def ingest(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Appends all that is there, by date, and ends; a restart goes on after what was written."""
    return stream.writeStream.format("parquet").partitionBy("date").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_with(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """The same with a sink of its own, such as a JDBC table."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
