"""Streaming forms of the event operators. Each takes any frame, so the same plan runs as a batch and as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """Files of a folder or glob as a stream, with ts as a timestamp (an event time can't be one without a zone)."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, size: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Rows and values of each window and type; on a stream, rows later than the watermark are left out."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return (
        events.withWatermark("ts", late)
        .groupBy(window.alias("w"), "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "event_type", "n", "total")
    )


def session_counts(events: DataFrame, gap: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Sessions of each user: rows less than the gap apart."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.session_window("ts", gap).alias("w"), "user_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")
    )


def first_of_each(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """The first row of each key within the watermark; state is dropped as it passes."""
    marked = events.withWatermark("ts", late)
    return marked.dropDuplicatesWithinWatermark(keys) if events.isStreaming else marked.dropDuplicates(keys)


def drain(df: DataFrame, path: str, checkpoint: str, mode: str = "append", kind: str = "parquet") -> None:
    """Run a stream over all there is now, into files, and stop. A restart over the same checkpoint goes on from there."""
    writer = df.writeStream.format(kind).outputMode(mode).option("checkpointLocation", checkpoint)
    writer.trigger(availableNow=True).start(path).awaitTermination()


def drain_batches(df: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> None:
    """Run a stream over all there is now, giving each batch to a function, and stop."""
    writer = df.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", checkpoint)
    writer.trigger(availableNow=True).start().awaitTermination()
