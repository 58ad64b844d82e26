"""From voxels to node time series: weighted group means through a membership join, and the activation table.

`membership(node_idx, vox_id)` is a multiset: a voxel that two seeds of a node cover counts twice, so it is never made distinct. Nodes that no voxel
reaches come back as NaN columns, since the label table alone says which columns there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Membership tables with at most so many rows are broadcast; larger ones join by shuffle.
BROADCAST_ROWS = 2_000_000
#: Columns of every activation table.
COLUMNS = ("t", "time_s", "stimulus_time_s", "good_frame", "run_idx", "ses", "run", "acq", "run_key", "cohort", "atlas", "task", "sub", "clip_idx", "v")


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df` with a broadcast hint if it is shown to have at most `rows` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def in_mask(voxels: DataFrame, mask: DataFrame) -> DataFrame:
    """Voxels (vox_id) inside the mask (vox_id)."""
    return voxels.join(mask.select("vox_id").distinct(), "vox_id", "left_semi")


def node_means_long(voxels: DataFrame, membership: DataFrame) -> DataFrame:
    """voxels(run_key, t, vox_id, v) -> run_key, t, node_idx, x (mean) and n_voxels. Partial sums come before the shuffle."""
    joined = voxels.join(small(membership), "vox_id")
    return joined.groupBy("run_key", "t", "node_idx").agg(F.avg(F.col("v").cast("double")).alias("x"), F.count(F.lit(1)).alias("n_voxels"))


def node_means(voxels: DataFrame, membership: DataFrame, n_nodes: int) -> DataFrame:
    """run_key, t, v: one array of n_nodes means per frame, NaN for nodes without voxels."""
    means = node_means_long(voxels, membership)
    packed = means.groupBy("run_key", "t").agg(F.map_from_entries(F.collect_list(F.struct("node_idx", F.col("x").cast("float").alias("x")))).alias("m"))
    every = F.transform(F.sequence(F.lit(0), F.lit(n_nodes - 1)), lambda i: F.coalesce(F.element_at(F.col("m"), i.cast("int")), F.lit(float("nan")).cast("float")))
    frames = voxels.select("run_key", "t").distinct().join(packed, ["run_key", "t"], "left")
    return frames.withColumn("m", F.coalesce("m", F.create_map().cast("map<int,float>"))).select("run_key", "t", every.alias("v"))


def explode_volumes(volumes: DataFrame) -> DataFrame:
    """volumes(run_key, t, v array) -> one row per voxel, vox_id its place in the array."""
    return volumes.select("run_key", "t", F.posexplode("v").alias("vox_id", "v"))


def activation_table(means: DataFrame, axis: DataFrame, runs: DataFrame, more: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """The activation contract: entities of the run, its clocks and flags, and v, in a fixed order and with fixed types; then the columns `more` of the runs as they are."""
    own = [c for c in ("cohort", "atlas", "task", "sub", "ses", "run", "acq", "clip_idx") if c in runs.columns and c not in axis.columns]
    joined = means.join(axis, ["run_key", "t"]).join(small(runs.select("run_key", *own, *more)), "run_key")
    have = lambda c, kind: (F.col(c) if c in joined.columns else F.lit(None)).cast(kind).alias(c)
    return joined.select(
        F.col("t").cast("int").alias("t"), F.col("time_s").cast("float").alias("time_s"), F.col("stimulus_time_s").cast("float").alias("stimulus_time_s"),
        (F.col("good_frame") if "good_frame" in joined.columns else F.lit(True)).alias("good_frame"), F.col("run_idx").cast("byte").alias("run_idx"),
        *[have(c, "string") for c in ("ses", "run", "acq", "run_key", "cohort", "atlas", "task", "sub")],
        have("clip_idx", "byte"), F.col("v").cast("array<float>").alias("v"), *more,
    )


def to_long(activation: DataFrame) -> DataFrame:
    """One row per frame and node: node_idx and x in place of v."""
    return activation.select(*[c for c in activation.columns if c != "v"], F.posexplode("v").alias("node_idx", "x"))


def to_wide(activation: DataFrame, columns: list[str]) -> DataFrame:
    """One column per node. Names that would hide a metadata column are an error."""
    clash = set(columns) & set(activation.columns)
    if clash:
        raise ValueError(f"node names are reserved columns: {', '.join(sorted(clash))}")
    return activation.select(*[c for c in activation.columns if c != "v"], *[F.get("v", F.lit(i)).alias(c) for i, c in enumerate(columns)])


def from_wide(table: DataFrame, columns: list[str]) -> DataFrame:
    """The array form of a wide table; missing node columns are an error."""
    missing = [c for c in columns if c not in table.columns]
    if missing:
        raise ValueError(f"activation lacks {len(missing)} node columns, as {', '.join(missing[:3])}")
    return table.select(*[c for c in table.columns if c not in columns], F.array(*[F.col(f"`{c}`").cast("float") for c in columns]).alias("v"))
