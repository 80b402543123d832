"""Streams: windowed trends with a bound on lateness, and upserts of the last state by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def trend(events: DataFrame, at: str, size: str, late: str, by: list[str], value: str) -> DataFrame:
    """Counts and sums by window of event time; rows later than `late` behind the greatest time seen are left out."""
    timed = events.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    sums = timed.groupBy(F.window("_at", size).alias("_w"), *by).agg(F.count("*").alias("total"), F.sum(value).alias("sum_value"))
    return sums.select(F.col("_w.start").alias("bucket"), *by, "total", "sum_value")


def sessions(events: DataFrame, at: str, gap: str, late: str, by: list[str]) -> DataFrame:
    """Sessions by key: a row without another within the gap ends one."""
    timed = events.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    sums = timed.groupBy(F.session_window("_at", gap).alias("_w"), *by).agg(F.count("*").alias("total"))
    return sums.select(F.col("_w.start").alias("started"), F.col("_w.end").alias("ended"), *by, "total")


def unique(events: DataFrame, at: str, late: str, keys: list[str]) -> DataFrame:
    """Each key once within the watermark, so that state stays bounded."""
    return events.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late).dropDuplicatesWithinWatermark(keys).drop("_at")


def into_table(stream: DataFrame, place: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Everything that is there now goes to Parquet files, once; a restart goes on where the checkpoint ends."""
    return stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(place)
