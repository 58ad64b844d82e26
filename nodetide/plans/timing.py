"""Acquisition and stimulus clocks, run segments, and censoring with dilation.

All are window functions partitioned by run, so every run is independent and the work spreads by run key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Where a time axis may come from (fixed values).
SOURCES = ("identity", "from_events", "from_log", "from_paper", "from_scans", "from_isc")
GAP_EPS = 1e-6


def segment_bounds(segments: DataFrame) -> DataFrame:
    """segments(run_key, seg_idx, n_vols, stimulus_offset_s) with first_t and end_t, the frames [first_t, end_t) of each segment."""
    upto = W.partitionBy("run_key").orderBy("seg_idx").rowsBetween(W.unboundedPreceding, 0)
    end = F.sum("n_vols").over(upto).cast("int")
    return segments.withColumn("end_t", end).withColumn("first_t", (F.col("end_t") - F.col("n_vols")).cast("int"))


def build_time_axis(runs: DataFrame, segments: DataFrame | None = None, source: str = "identity") -> DataFrame:
    """runs(run_key, n_tr, tr) -> run_key, t, time_s, stimulus_time_s (floats), run_idx (byte), timing_source.

    Without segments of a run its axis is one segment from 0. Segments must sum to n_tr; more than 128 of them are an error."""
    if source not in SOURCES:
        raise ValueError(f"timing source must be one of {', '.join(SOURCES)}")
    if segments is None:
        held = runs.withColumn("segs", F.array(F.struct(F.lit(0).alias("seg_idx"), F.lit(0).alias("first_t"), F.col("n_tr").cast("int").alias("end_t"), F.lit(0.0).alias("offset"))))
    else:
        packed = segment_bounds(segments).groupBy("run_key").agg(F.sort_array(F.collect_list(F.struct(F.col("seg_idx").cast("int").alias("seg_idx"), "first_t", "end_t", F.col("stimulus_offset_s").cast("double").alias("offset")))).alias("segs"), F.sum("n_vols").alias("vols"))
        held = runs.join(packed, "run_key", "left").withColumn("segs", F.when(F.col("vols").isNull(), F.array(F.struct(F.lit(0).alias("seg_idx"), F.lit(0).alias("first_t"), F.col("n_tr").cast("int").alias("end_t"), F.lit(0.0).alias("offset")))).when(F.col("vols") != F.col("n_tr"), F.raise_error(F.concat(F.lit("segments do not sum to n_tr in "), F.col("run_key")))).otherwise(F.col("segs")))
        held = held.withColumn("segs", F.when(F.size("segs") > 128, F.raise_error(F.lit("more than 128 segments in a run"))).otherwise(F.col("segs")))
    rows = held.select("run_key", "tr", F.posexplode("segs").alias("run_idx", "s")).select("run_key", "tr", "run_idx", "s", F.explode(F.when(F.col("s.end_t") > F.col("s.first_t"), F.sequence(F.col("s.first_t"), F.col("s.end_t") - 1))).alias("t"))
    local = (F.col("t") - F.col("s.first_t")) * F.col("tr")
    return rows.select("run_key", "t", (F.col("t") * F.col("tr")).cast("float").alias("time_s"), (F.col("s.offset") + local).cast("float").alias("stimulus_time_s"), F.col("run_idx").cast("byte").alias("run_idx"), F.lit(source).alias("timing_source"))


def segments_from_scans(scans: DataFrame, drop_after_restart: int = 0) -> DataFrame:
    """scans(run_key, seg_idx, acq_s, n_vols, tr) -> segments. Gaps between scans don't advance the stimulus, nor do volumes that go; scans after the first lose
    `drop_after_restart` volumes; a scan that begins before the one before it has ended is an error."""
    order = W.partitionBy("run_key").orderBy("seg_idx")
    gap = F.col("acq_s") - (F.lag("acq_s").over(order) + F.lag("n_vols").over(order) * F.lag("tr").over(order))
    kept = F.col("n_vols") - F.when(F.row_number().over(order) > 1, drop_after_restart).otherwise(0)
    d = scans.withColumns({"gap_s": gap, "kept": kept})
    d = d.withColumn("kept", F.when(F.col("gap_s") < -GAP_EPS, F.raise_error(F.concat(F.lit("negative gap between scans of "), F.col("run_key"))).cast("int")).otherwise(F.col("kept")))
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    return d.withColumn("stimulus_offset_s", F.sum(F.col("kept") * F.col("tr")).over(upto) - F.col("kept") * F.col("tr")).select("run_key", "seg_idx", F.col("kept").cast("int").alias("n_vols"), "stimulus_offset_s")


def dilated(good: Column, k: int, run: str = "run_key", t: str = "t") -> Column:
    """A frame stays good if all frames within k of it in its run are good; nothing wraps around."""
    if k < 0:
        raise ValueError("dilation must be 0 or more")
    return good if k == 0 else F.bool_and(good).over(W.partitionBy(run).orderBy(t).rowsBetween(-k, k))


def censor_mask(axis: DataFrame, censored: DataFrame | None = None, keep: DataFrame | None = None, dilate_tr: int = 1) -> DataFrame:
    """axis(run_key, t, ...) with good_frame: not in censored(run_key, t), keep(run_key, t, keep) not false, then dilated. Indices beyond the axis are ignored."""
    d = axis
    good = F.lit(True)
    if censored is not None:
        d = d.join(censored.select("run_key", "t").distinct().withColumn("_cut", F.lit(True)), ["run_key", "t"], "left")
        good = good & F.col("_cut").isNull()
    if keep is not None:
        d = d.join(keep.select("run_key", "t", F.col("keep").alias("_keep")), ["run_key", "t"], "left")
        good = good & F.coalesce("_keep", F.lit(True))
    d = d.withColumn("good_frame", good)
    return d.withColumn("good_frame", dilated(F.col("good_frame"), dilate_tr)).drop("_cut", "_keep")


def check_censor_length(keep: DataFrame, runs: DataFrame) -> DataFrame:
    """Runs whose censor file hasn't a row for each frame: run_key, n_tr, n_rows."""
    n = keep.groupBy("run_key").agg(F.count("*").alias("n_rows"))
    return runs.join(n, "run_key").filter("n_rows != n_tr").select("run_key", "n_tr", "n_rows")


def trim(frames: DataFrame, end_s: str = "trim_end_s", tr: str = "tr", n_tr: str = "n_tr", mode: str = "end") -> DataFrame:
    """Keeps frames t < round-half-even(end_s / tr). Null ends keep all; `start` keeps all; `both` is `end`; an end beyond the run is an error."""
    if mode not in ("start", "end", "both"):
        raise ValueError("trim mode must be start, end or both")
    if mode == "start":
        return frames
    n = F.bround(F.col(end_s) / F.col(tr)).cast("int")
    over = F.raise_error(F.concat(F.lit("trim is longer than the run: "), n.cast("string"))).cast("boolean")
    return frames.filter(F.when(F.col(end_s).isNull(), True).when(n > F.col(n_tr), over).otherwise(F.col("t") < n))


def whole_frames(seconds: Column, tr: Column) -> Column:
    """Whether a time is a whole number of frames, within 1e-6."""
    q = seconds / tr
    return F.abs(q - F.bround(q)) <= 1e-6
