"""Windows over events, in batch and in streams with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, length: str, slide: str | None = None, ts: str = "ts", keys: tuple[str, ...] = (), late: str | None = None) -> DataFrame:
    """Counts and sums per window and key. ``late``: the watermark, for streams."""
    if late:
        events = events.withWatermark(ts, late)
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    out = events.groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n", "total")


def sessions(events: DataFrame, gap: str, key: str = "user_id", ts: str = "ts", late: str | None = None) -> DataFrame:
    if late:
        events = events.withWatermark(ts, late)
    out = events.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return out.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")
