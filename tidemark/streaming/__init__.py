"""Structured Streaming over engine tables. The engine's own batch queries have no streams; these are additions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.engine import Engine
from tidemark.types import TS


def append_stream(engine: Engine, table: str, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
    """Appends a stream with the table's columns, a commit for each micro-batch.

    The commit holds the number of the checkpoint's last batch, so a batch that is tried again after a failure is not
    appended twice: each row is in the table exactly once.
    """
    name = checkpoint.rstrip("/")
    return stream.writeStream.foreachBatch(lambda batch, number: engine.append_dataframe(table, batch, (name, number)) and None).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def bucketed(stream: DataFrame, step_ms: int, late_ms: int, *aggregates: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """Tumbling windows of step_ms from the epoch on, as time_bucket() makes them; rows over late_ms late are dropped."""
    timed = stream.withColumn("_time", F.timestamp_millis(TS)).withWatermark("_time", f"{late_ms} milliseconds")
    windows = timed.groupBy(F.window("_time", f"{step_ms} milliseconds"), *by).agg(*aggregates)
    return windows.select(F.unix_millis("window.start").alias("bucket"), *(c for c in windows.columns if c != "window"))


def sliding(stream: DataFrame, length_ms: int, step_ms: int, late_ms: int, *aggregates: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """Windows of length_ms that start every step_ms."""
    timed = stream.withColumn("_time", F.timestamp_millis(TS)).withWatermark("_time", f"{late_ms} milliseconds")
    windows = timed.groupBy(F.window("_time", f"{length_ms} milliseconds", f"{step_ms} milliseconds"), *by).agg(*aggregates)
    return windows.select(F.unix_millis("window.start").alias("start"), *(c for c in windows.columns if c != "window"))


def session_windows(stream: DataFrame, gap_ms: int, late_ms: int, *aggregates: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """Windows that end gap_ms after their last row."""
    timed = stream.withColumn("_time", F.timestamp_millis(TS)).withWatermark("_time", f"{late_ms} milliseconds")
    windows = timed.groupBy(F.session_window("_time", f"{gap_ms} milliseconds"), *by).agg(*aggregates)
    return windows.select(F.unix_millis("session_window.start").alias("start"), F.unix_millis("session_window.end").alias("end"), *(c for c in windows.columns if c != "session_window"))
