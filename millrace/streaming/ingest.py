"""Streaming ingestion of JSONL shards: an addition, as batch inputs may also arrive over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import content_key


def records(spark: SparkSession, folder: str, delay: str = "10 minutes") -> DataFrame:
    """New lines of a folder's files, each content once within the delay."""
    lines = spark.readStream.text(folder).withColumn("seen", F.current_timestamp())
    keyed = lines.where("trim(value) <> ''").withColumn("key", content_key(F.col("value")))
    return keyed.withWatermark("seen", delay).dropDuplicatesWithinWatermark(["key"])


def counts(events: DataFrame, ts: str, by: str, window: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Events for each window and key, of a stream or a table."""
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", delay)
    return timed.groupBy(F.window("_ts", window).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")
