"""Overlapping half-open windows on one stimulus grid, and which windows hold a frame.

A window k is [k * stride, k * stride + width), stride = width / overlaps. Starts are products, never running sums, so the grid
doesn't drift. Membership generates the few windows that may hold a frame and then applies the exact test, so a range join is an
explode and a filter: no nested loop and no shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Slack in seconds at both ends of a window.
EPS = 1e-9


def nominal_frames(width_s: Column, tr: Column) -> Column:
    """Frames of a window: floor(width / TR + 1/2); widths and TRs must be above 0."""
    bad = (width_s <= 0) | (tr <= 0)
    return F.when(bad, F.raise_error(F.lit("window and TR must be positive")).cast("int")).otherwise(F.floor(width_s / tr + 0.5).cast("int"))


def stride(width_s: Column, overlaps: int) -> Column:
    if overlaps < 1:
        raise ValueError("n_overlaps must be at least 1")
    return width_s / F.lit(float(overlaps))


def window_count(duration_s: Column, width_s: Column, overlaps: int, drop_incomplete: bool = True) -> Column:
    step = stride(width_s, overlaps)
    whole = F.when(duration_s + EPS < width_s, 0).otherwise(F.floor((duration_s - width_s) / step + EPS) + 1)
    n = whole if drop_incomplete else F.ceil(duration_s / step - EPS)
    return F.when(duration_s <= 0, 0).otherwise(n).cast("int")


def grid_size(duration_s: float, width_s: float, overlaps: int, drop_incomplete: bool = True) -> int:
    """`window_count` of plain numbers."""
    if overlaps < 1:
        raise ValueError("n_overlaps must be at least 1")
    step = width_s / overlaps
    if duration_s <= 0:
        return 0
    if not drop_incomplete:
        return math.ceil(duration_s / step - EPS)
    return 0 if duration_s + EPS < width_s else math.floor((duration_s - width_s) / step + EPS) + 1


def stimulus_grid(spans: DataFrame, overlaps: int = 5, drop_incomplete: bool = True) -> DataFrame:
    """spans(..., duration_s, window_s) -> the same columns with window_id, start_s and end_s, one row a window."""
    n = window_count(F.col("duration_s"), F.col("window_s"), overlaps, drop_incomplete)
    rows = spans.withColumn("window_id", F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1))))
    start = F.col("window_id") * stride(F.col("window_s"), overlaps)
    return rows.withColumns({"start_s": start, "end_s": start + F.col("window_s")})


def contains(t: Column, start: Column, end: Column) -> Column:
    return (t >= start - EPS) & (t < end - EPS)


def window_ids(t: Column, width_s: Column, overlaps: int) -> Column:
    """All ids of windows that hold time t, whatever the grid's length; an empty array where there is none."""
    step = stride(width_s, overlaps)
    hi = F.floor(t / step + EPS).cast("int")
    lo = F.greatest(F.lit(0), (F.floor((t - width_s) / step + EPS) + 1).cast("int"))
    return F.when(hi >= lo, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))


def assign_windows(frames: DataFrame, time: str = "stimulus_time_s", overlaps: int = 5, drop_incomplete: bool = True) -> DataFrame:
    """frames(..., duration_s, window_s) -> a row for every window of the grid that holds the frame, with window_id, start_s and end_s.

    The candidates are one id wider at both ends than arithmetic asks; the exact test decides."""
    t, width = F.col(time).cast("double"), F.col("window_s")
    step = stride(width, overlaps)
    n = window_count(F.col("duration_s"), width, overlaps, drop_incomplete)
    lo = F.greatest(F.lit(0), F.floor((t - width) / step).cast("int") - 1)
    hi = F.least(n - 1, F.floor(t / step).cast("int") + 1)
    rows = frames.withColumn("window_id", F.explode(F.when(hi >= lo, F.sequence(lo, hi))))
    start = F.col("window_id") * step
    return rows.withColumns({"start_s": start, "end_s": start + width}).filter(contains(t, F.col("start_s"), F.col("end_s")))


def index_windows(runs: DataFrame, overlaps: int = 5, drop_incomplete: bool = True) -> DataFrame:
    """runs(..., n_tr, window_tr) -> window_id, start_tr, end_tr by row index; stride max(1, window // overlaps); a window under 2 frames is an error."""
    n, w = F.col("n_tr"), F.when(F.col("window_tr") < 2, F.raise_error(F.lit("window must have at least 2 frames")).cast("int")).otherwise(F.col("window_tr"))
    step = F.greatest(F.lit(1), F.floor(w / overlaps).cast("int"))
    last = n - w if drop_incomplete else n - 1
    rows = runs.withColumn("start_tr", F.explode(F.when((last >= 0) & (w >= 2), F.sequence(F.lit(0), last.cast("int"), step))))
    return rows.withColumns({"window_id": F.floor(F.col("start_tr") / step).cast("int"), "end_tr": F.least(n, F.col("start_tr") + w).cast("int")})


def register_grid_function(spark: SparkSession, name: str = "stimulus_windows") -> None:
    """A table function for SQL users: stimulus_windows(duration_s, window_s, overlaps)."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="window_id int, start_s double, end_s double")
    class StimulusWindows:
        def eval(self, duration_s: float, window_s: float, overlaps: int):
            step = window_s / overlaps
            for k in range(grid_size(duration_s, window_s, overlaps)):
                yield k, k * step, k * step + window_s

    spark.udtf.register(name, StimulusWindows)
