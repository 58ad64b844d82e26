"""Coverage, left-right similarity, and alignment of subjects with the leave-one-out mean."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nodetide.functions.names import hemisphere_stem, is_finite
from nodetide.operators.connectivity import safe_pearson


def coverage(frames: DataFrame) -> DataFrame:
    """frames(task, stimulus_time_s, good_frame) -> movie, stimulus_time_s, n_good, n_total over all subjects."""
    return frames.groupBy(F.col("task").alias("movie"), "stimulus_time_s").agg(F.count_if("good_frame").alias("n_good"), F.count("*").alias("n_total"))


def hemisphere_pairs(nodes: DataFrame) -> DataFrame:
    """nodes(node_idx, name, hemi, column) -> region, left, right and both node_idx, for stems that have both sides."""
    side = lambda h, c: F.max(F.when(F.col("hemi") == h, F.col(c)))
    g = nodes.groupBy(hemisphere_stem(F.col("name")).alias("region")).agg(side("L", "column").alias("left"), side("R", "column").alias("right"), side("L", "node_idx").alias("left_idx"), side("R", "node_idx").alias("right_idx"))
    return g.filter("left IS NOT NULL AND right IS NOT NULL")


def left_right(activation: DataFrame, nodes: DataFrame, threshold: float = 0.95) -> DataFrame:
    """Mean correlation of each left-right pair over runs, highest first, undefined last. n_subjects counts runs with a valid correlation."""
    pairs = hemisphere_pairs(nodes).agg(F.collect_list(F.struct("region", "left_idx", "right_idx")).alias("pairs"))  # one row, of a label table
    value = lambda p, s: F.get(F.col("v"), p[f"{s}_idx"]).cast("double")
    good = activation.filter("good_frame").select("run_key", "v").crossJoin(pairs)
    d = good.select("run_key", F.explode(F.transform("pairs", lambda p: F.struct(p["region"].alias("region"), value(p, "left").alias("x"), value(p, "right").alias("y")))).alias("p")).select("run_key", "p.*")
    d = d.filter(is_finite(F.col("x")) & is_finite(F.col("y")))
    per_run = d.groupBy("run_key", "region").agg(F.count("*").alias("n"), safe_pearson(F.col("x"), F.col("y")).alias("r")).filter("n > 2 AND NOT isnan(r)")
    mean = per_run.groupBy("region").agg(F.count("*").alias("n_subjects"), F.avg("r").alias("mean_lr_r"))
    out = hemisphere_pairs(nodes).join(mean, "region", "left").select("region", "left", "right", F.coalesce("n_subjects", F.lit(0)).alias("n_subjects"), F.coalesce("mean_lr_r", F.lit(float("nan"))).alias("mean_lr_r"))
    out = out.withColumn("merge_candidate", ~F.isnan("mean_lr_r") & (F.col("mean_lr_r") >= threshold))
    return out.orderBy(F.when(F.isnan("mean_lr_r"), None).otherwise(F.col("mean_lr_r")).desc_nulls_last())


def zscore(x, partition: list[str]):
    """(x - mean) / population sd over a partition, skipping NaN; NaN where the sd is 0."""
    w = W.partitionBy(*partition)
    defined = F.when(~F.isnan(x), x)
    sd = F.stddev_pop(defined).over(w)
    return F.when(sd > 0, (x - F.avg(defined).over(w)) / sd).otherwise(F.lit(float("nan")))


def isc_alignment(series: DataFrame, max_lag: int = 30, pooled: bool = False, least: int = 10) -> DataFrame:
    """series(run_key, sub, task, t, x) -> sub, movie, best_lag_tr, peak_isc: the lag at which each run matches the mean of the others best.

    Runs are compared within their task (or all together, if pooled), over the frames of the shortest. Ties go to the lowest lag; with fewer than `least` common frames everywhere
    the lag is 0 and the peak -inf. Groups of fewer than 3 runs give no rows."""
    task = F.lit("") if pooled else F.col("task")
    d = series.withColumn("g", task)
    length = d.groupBy("g", "run_key").agg(F.max("t").alias("last"))
    group = length.groupBy("g").agg(F.min("last").alias("last"), F.count("*").alias("runs")).filter("runs >= 3")
    d = d.join(group, "g").filter(F.col("t") <= F.col("last"))
    d = d.withColumn("z", zscore(F.col("x").cast("double"), ["g", "run_key"]))
    d = d.withColumn("rest", (F.sum("z").over(W.partitionBy("g", "t")) - F.col("z")) / (F.col("runs") - 1))
    moved = d.select("g", "run_key", "z", F.col("t").alias("t0"), F.explode(F.sequence(F.lit(-max_lag), F.lit(max_lag))).alias("lag")).withColumn("t", F.col("t0") + F.col("lag"))
    both = moved.join(d.select("g", "run_key", "t", "rest"), ["g", "run_key", "t"]).filter(is_finite(F.col("z")) & is_finite(F.col("rest")))
    r = both.groupBy("g", "run_key", "lag").agg(F.count("*").alias("n"), safe_pearson(F.col("z"), F.col("rest")).alias("r")).filter(F.col("n") >= least).filter(~F.isnan("r"))
    best = r.groupBy("g", "run_key").agg(F.min_by(F.struct("lag", "r"), F.struct(-F.col("r"), F.col("lag"))).alias("b"))
    runs = d.select("g", "run_key", "sub", "task").distinct()
    return runs.join(best, ["g", "run_key"], "left").select("sub", F.col("task").alias("movie"), F.coalesce("b.lag", F.lit(0)).cast("int").alias("best_lag_tr"), F.coalesce("b.r", F.lit(float("-inf"))).alias("peak_isc"))


def isc_gate(isc: DataFrame, most: float = 1.0) -> DataFrame:
    """One row: median_abs_lag, n and status passed, failed or skipped (no series)."""
    m = isc.agg(F.median(F.abs("best_lag_tr")).alias("median_abs_lag"), F.count("*").alias("n"))
    return m.withColumn("status", F.when(F.col("n") == 0, "skipped").when(F.col("median_abs_lag") <= most, "passed").otherwise("failed"))
