"""Streams: new texts are scanned as they come, contents seen before are skipped for a
time, and findings and events are counted by windows with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..model import COLUMNS, ScanOptions
from ..operators import post
from ..plans.scan import scan


def unseen(texts: DataFrame, within: str = "14 days", time: str = "ts") -> DataFrame:
    """Texts whose content didn't come before within the time: the streaming form of the result cache."""
    hashed = texts.withColumn("content_hash", F.sha2(F.col("text").cast("binary"), 256)).withWatermark(time, within)
    return hashed.dropDuplicatesWithinWatermark(["content_hash"]) if texts.isStreaming else hashed.dropDuplicates(["content_hash"])


def scan_stream(texts: DataFrame, path: str, checkpoint: str, options: ScanOptions | None = None, within: str = "14 days", ignored: DataFrame | None = None, **trigger) -> StreamingQuery:
    """Scan a stream (file, text, ts) and append each batch's findings to a Parquet
    table, partitioned by batch: a batch that is run again replaces its own partition."""

    def batch(rows: DataFrame, number: int) -> None:
        found = scan(rows.select("file", "text"), options)
        if ignored is not None:
            found = post.suppress(found, ignored)
        found.select(COLUMNS).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return unseen(texts, within).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _timed(events: DataFrame, time: str, late: str) -> DataFrame:
    """Events with a watermark; a stream's time must have a zone, and gets the session's."""
    if events.isStreaming and events.schema[time].dataType.simpleString() == "timestamp_ntz":
        events = events.withColumn(time, F.col(time).cast("timestamp"))
    return events.withWatermark(time, late)


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes", time: str = "ts", key: str = "event_type", value: str = "value") -> DataFrame:
    """Events by window and key; on a stream, windows close `late` after their end."""
    return _timed(events, time, late).groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n"), F.round(F.sum(value), 3).alias("total")).select(F.col("w.start").alias("window_start"), key, "n", "total")


def sliding(events: DataFrame, width: str = "2 hours", step: str = "1 hour", late: str = "10 minutes", time: str = "ts", key: str = "event_type") -> DataFrame:
    return _timed(events, time, late).groupBy(F.window(time, width, step).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), key, "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", time: str = "ts", key: str = "user_id") -> DataFrame:
    """Sessions of a key: events no more than a gap apart."""
    return _timed(events, time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")
