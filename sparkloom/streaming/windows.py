"""Windowed aggregates that work alike on batch and streaming DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tumbling(df: DataFrame, time: str, width: str, keys: list[str], values: list[Column], *, late: str | None = None, slide: str | None = None) -> DataFrame:
    """Aggregates by fixed (or sliding) event-time windows; ``late`` sets a stream's watermark."""
    src = df.withWatermark(time, late) if late and df.isStreaming else df
    window = F.window(time, width, slide) if slide else F.window(time, width)
    out = src.groupBy(window.alias("w"), *keys).agg(*values)
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[c for c in out.columns if c != "w"])


def sessions(df: DataFrame, time: str, gap: str, keys: list[str], values: list[Column], *, late: str | None = None) -> DataFrame:
    """Aggregates by sessions: events of a key less than ``gap`` apart."""
    src = df.withWatermark(time, late) if late and df.isStreaming else df
    out = src.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(*values)
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[c for c in out.columns if c != "w"])
