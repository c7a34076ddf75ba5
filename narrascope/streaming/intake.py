"""Streaming intake of documents and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def first_documents(stream: DataFrame, day: str = "available_at", delay: str = "30 days", by: tuple[str, ...] = ()) -> DataFrame:
    """Documents as they come, without repeats of a text inside the watermark; one for each value of ``by`` that comes with it.

    Which of equal texts comes first is chance within a batch: what is to be told of a text must not differ between its rows, or be in ``by``.
    """
    return stream.withColumn("content_hash", F.sha2("text", 256)).withWatermark(day, delay).dropDuplicatesWithinWatermark(["content_hash", *by])


def windowed_counts(stream: DataFrame, ts: str, key: str, width: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Counts and sums by event-time window and key; windows close when the watermark passes them."""
    return stream.withWatermark(ts, delay).groupBy(F.window(ts, width).alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(stream: DataFrame, ts: str, key: str, gap: str) -> DataFrame:
    return stream.withWatermark(ts, gap).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n"))


def drain(spark: SparkSession, df: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Run a stream over all that is there and give its result as a table.

    Rows that are appended go from the executors to files beside the checkpoint, since they grow with the stream; a complete
    result, the groups of an aggregation, is a table in memory.
    """
    sink = df.writeStream.outputMode(mode).queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        sink.format("parquet").start(f"{checkpoint}-rows").awaitTermination()
        return spark.read.schema(df.schema).parquet(f"{checkpoint}-rows")
    spark.catalog.dropTempView(name)
    sink.format("memory").start().awaitTermination()
    return spark.table(name)
