"""Event streams: windows with late data, sessions, duplicates, latest state. Each works on batches and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream over a folder of event files with the schema of those there now; ``ts`` as a point in time."""
    schema = spark.read.parquet(folder).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))  # watermarks need the type with a zone


def late_bound(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Rows later than the delay behind the newest are dropped by stateful operators; no effect on batches."""
    return events.withWatermark("ts", delay)


def tumbling(events: DataFrame, width: str) -> DataFrame:
    w = F.window("ts", width)
    return events.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 2).alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "events", "total")


def sliding(events: DataFrame, width: str, step: str) -> DataFrame:
    w = F.window("ts", width, step)
    return events.groupBy(w.alias("w")).agg(F.count("*").alias("events")).select(F.col("w.start").alias("window_start"), "events")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """Sessions of each user: events at most ``gap`` apart."""
    w = F.session_window("ts", gap)
    return events.groupBy(w.alias("w"), "user_id").agg(F.count("*").alias("events")).select("user_id", F.col("w.start").alias("session_start"), "events")


def without_repeats(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each event id once within the delay."""
    if events.isStreaming:
        return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])
    return events.dropDuplicates(["event_id"])


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process all there is and stop; a second run continues where the first ended."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
