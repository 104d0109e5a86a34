"""Structured Streaming over check events (label_id, step, status, ts): statuses by window with a watermark for late events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from larder.operators.checks import STATUSES, rank, status_of

EVENT_SCHEMA = "label_id string, step int, status string, ts timestamp"


def status_by_window(events: DataFrame, length: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Per window and step the worst status and the count of each status."""
    counts = [F.count_if(F.col("status") == s).alias(f"n_{s}") for s in reversed(STATUSES)]
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", length), "step").agg(F.max(rank(F.col("status"))).alias("rank"), *counts)
    return grouped.select(F.col("window.start").alias("start"), "step", status_of(F.col("rank")).alias("status"), *[f"n_{s}" for s in reversed(STATUSES)])


def sessions(events: DataFrame, gap: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Audit sessions of a label: events with no gap between them, with their worst status."""
    grouped = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "label_id").agg(F.max(rank(F.col("status"))).alias("rank"), F.count("*").alias("n"))
    return grouped.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "label_id", status_of(F.col("rank")).alias("status"), "n")


def write_parquet(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append finished windows to Parquet, exactly once by the checkpoint; ends when all available input is read."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
