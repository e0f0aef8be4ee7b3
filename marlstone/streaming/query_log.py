"""Streams: windows over the query log, the log's sink, and entity counts kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

LATE = "10 minutes"


def event_time(events: DataFrame) -> DataFrame:
    """events with ts as a time stamp that a watermark accepts."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = LATE) -> DataFrame:
    """(start, event_type, n, total) by tumbling or sliding windows; works on streams and on tables."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    rows = event_time(events)
    rows = rows.withWatermark("ts", late) if events.isStreaming else rows
    out = rows.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = LATE) -> DataFrame:
    """(user_id, start, end, n): a user's events with no pause of ``gap`` between."""
    rows = event_time(events)
    rows = rows.withWatermark("ts", late) if events.isStreaming else rows
    out = rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def entity_counts(mentions: DataFrame) -> DataFrame:
    """(name, count) of a stream of mentions, for update or complete mode."""
    return mentions.groupBy("name").agg(F.count(F.lit(1)).alias("count"))


def write_log(records: DataFrame, path: str, checkpoint: str, every: str = "10 seconds", once: bool = False) -> StreamingQuery:
    """Appends records to a JSON log; a batch that is run again replaces its own folder."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").json(f"{path}/batch={number}")

    writer = records.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()
