"""Overlapping windows over a stream of frames, as an extension of the batch grid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_quality_stream(frames: DataFrame, keys: list[str], width_s: float, overlaps: int = 5, late_s: float = 60.0, origin: str = "1970-01-01 00:00:00", time: str = "ts", good: str = "good_frame") -> DataFrame:
    """Counts of available and good frames per window as event time passes; frames later than late_s are dropped.

    Windows that begin before `origin` (which the batch grid doesn't have) are left out. Works on batch tables alike."""
    step = width_s / overlaps
    w = F.window(F.col(time), f"{int(width_s * 1_000_000)} microseconds", f"{int(step * 1_000_000)} microseconds")
    d = frames.withWatermark(time, f"{int(late_s * 1000)} milliseconds") if frames.isStreaming else frames
    counts = d.groupBy(*keys, w.alias("w")).agg(F.count("*").alias("n_tr_available"), F.count_if(good).alias("n_tr_effective"))
    first = F.to_timestamp(F.lit(origin))
    return counts.filter(F.col("w.start") >= first).select(*keys, F.round((F.unix_micros(F.col("w.start").cast("timestamp")) - F.unix_micros(first)) / (step * 1e6)).cast("int").alias("window_id"), F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_tr_available", "n_tr_effective")
