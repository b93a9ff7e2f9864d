"""Windows over events, the same for a stream and a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def zoned(events: DataFrame, late: str | None) -> DataFrame:
    """Watermarks need zoned time; windows are given in the events' own. late: the watermark of a stream."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if late else events


def event_windows(events: DataFrame, size: str = "1 hour", late: str | None = None, *, slide: str | None = None) -> DataFrame:
    """Per window and type: n and value. slide: windows of size begin so often, and an event is in all that hold it."""
    by = zoned(events, late).groupBy(F.window("ts", size, slide).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("value"))
    return by.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "value")


def event_sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None, key: str = "user_id") -> DataFrame:
    """Per key, the runs of events no further apart than gap: session_start, session_end (gap after the last), n, value."""
    by = zoned(events, late).groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("value"))
    return by.select(key, F.col("w.start").cast("timestamp_ntz").alias("session_start"), F.col("w.end").cast("timestamp_ntz").alias("session_end"), "n", "value")


def stream_once(spark: SparkSession, source: str, schema, sink: str, checkpoint: str, size: str = "1 hour", *, windows=event_windows):
    """Process what is there and end; repeated runs go on from the checkpoint and give each row once."""
    events = spark.readStream.schema(schema).parquet(source)
    out = windows(events, size, late="0 seconds")
    return out.writeStream.outputMode("append").format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
