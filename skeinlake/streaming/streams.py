"""Structured Streaming: page ingestion, de-duplication within a watermark, windows of events, lease state."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

WATERMARK = "10 minutes"


def read(spark: SparkSession, folder: str, schema: str, per_trigger: int = 100) -> DataFrame:
    """A stream over the Parquet files of a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def dedupe(stream: DataFrame, keys: list[str], time: str, watermark: str = WATERMARK) -> DataFrame:
    """First row of each key; state of a key is dropped once the watermark has passed it."""
    return stream.withWatermark(time, watermark).dropDuplicatesWithinWatermark(keys)


def event_counts(stream: DataFrame, time: str, kind: str, width: str = "1 hour", slide: str | None = None, watermark: str = WATERMARK) -> DataFrame:
    """Events and sum of values by window and kind; tumbling, or sliding with a slide."""
    windows = F.window(time, width, slide) if slide else F.window(time, width)
    x = stream.withWatermark(time, watermark) if stream.isStreaming else stream
    return x.groupBy(windows.alias("w"), kind).agg(F.count("*").alias("events")).select(F.col("w.start").alias("start"), kind, "events")


def sessions(stream: DataFrame, time: str, key: str, gap: str = "30 minutes", watermark: str = WATERMARK) -> DataFrame:
    """Sessions of a key that end after a gap."""
    x = stream.withWatermark(time, watermark) if stream.isStreaming else stream
    return x.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("events")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def ingest(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None]):
    """Runs a sink on every micro-batch; with a sink that overwrites by batch number each batch counts once."""
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()


def to_parquet(stream: DataFrame, folder: str, checkpoint: str, by: list[str] = ()):
    """Appends a stream to Parquet exactly once."""
    w = stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return (w.partitionBy(*by) if by else w).start()


def latest_state(stream: DataFrame, key: str, value: str, time: str) -> DataFrame:
    """The value of the latest event of each key, as a running table; ties in time give the greater value."""
    return stream.groupBy(key).agg(F.max_by(value, F.struct(time, value)).alias(value), F.max(time).alias(time))
