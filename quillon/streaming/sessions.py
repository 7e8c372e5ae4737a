"""Sessions of events, as a batch and as a stream (an extension: the reference reads files only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessionise(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Runs of a user's events less than gap apart."""
    w = F.session_window(F.col("ts").cast("timestamp"), gap)
    rows = events.groupBy("user_id", w.alias("w")).agg(F.min("ts").alias("session_start"), F.max("ts").alias("last_event"), F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("value"))
    return rows.drop("w")


def stream_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """The same over a stream with event time ts: state is dropped once the watermark has passed, later events with it."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.dropDuplicatesWithinWatermark(["event_id"]).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events"), F.sum("value").alias("value")).select("user_id", F.col("w.start").alias("session_start"), "events", "value")


def upsert_stream(stream: DataFrame, merge, checkpoint: str):
    """Start a query that hands each micro-batch to merge(batch, batch_id); merge must give the same table when a batch comes
    twice, as an upsert by key does."""
    return stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(merge).start()
