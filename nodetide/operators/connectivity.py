"""Windowed all-pairs correlation with quality flags.

Two physical forms of the same operator. `pearson_long` is all built-in: frames meet in a self-join by (run, window, frame) and one aggregate gives every pair
(rows grow with the square of the nodes, so it suits small node sets and SQL checks). `dfc` and `pearson_packed` keep one array per frame and multiply
matrices in an Arrow-batched function: `dfc` ships each frame once to its run, whatever the number of windows, sizes and pairs.

NaN means undefined and is never turned into null in stored data: a NaN sample of a node makes that node's edges NaN.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nodetide.operators.extract import small
from nodetide.plans.grid import EPS, grid_size

NAN = float("nan")


def safe_pearson(x: Column, y: Column) -> Column:
    """Pearson's r clipped to [-1, 1]; NaN below two rows, for constants, and where a value is NaN."""
    undefined = (F.count(F.lit(1)) < 2) | (F.var_pop(x) == 0) | (F.var_pop(y) == 0)
    r = F.when(undefined, F.lit(NAN)).otherwise(F.covar_pop(x, y) / (F.stddev_pop(x) * F.stddev_pop(y)))
    return r


def clip_r(r: Column) -> Column:
    """Clipping that leaves NaN as it is (least() and greatest() would not)."""
    return F.when(F.isnan(r), r).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def window_quality(keys: list[str], n_nodes: Column | int) -> list[Column]:
    """Aggregates of a window over its available frames: counts, first good frame, boundary crossings and rank."""
    good = F.col("good_frame")
    n_eff = F.count_if(good)
    nodes = F.lit(n_nodes) if isinstance(n_nodes, int) else F.max(n_nodes)
    first = F.min_by(F.struct("t", "time_s"), F.when(good, F.col("t")))
    crosses = lambda c: F.coalesce(F.min(c) != F.max(c), F.lit(False))
    return [
        F.count(F.lit(1)).cast("short").alias("n_tr_available"),
        n_eff.cast("short").alias("n_tr_effective"),
        (n_eff / F.count(F.lit(1))).cast("float").alias("frac_good_frames"),
        first["t"].cast("int").alias("start_tr"),
        first["time_s"].cast("float").alias("start_s"),
        crosses("run_idx").alias("crosses_run_boundary"),
        crosses("clip_idx").alias("crosses_clip_boundary"),
        (n_eff - 1 < nodes).alias("rank_deficient"),
    ]


def with_defaults(frames: DataFrame) -> DataFrame:
    """Missing optional columns: good_frame true, run_idx 0, clip_idx null, time_s the stimulus time, t the row's place in its run."""
    from pyspark.sql import Window as W

    have = set(frames.columns)
    add = {}
    if "good_frame" not in have:
        add["good_frame"] = F.lit(True)
    if "run_idx" not in have:
        add["run_idx"] = F.lit(0).cast("byte")
    if "clip_idx" not in have:
        add["clip_idx"] = F.lit(None).cast("byte")
    if "time_s" not in have:
        add["time_s"] = F.col("stimulus_time_s")
    if "t" not in have:
        add["t"] = (F.row_number().over(W.partitionBy("run_key").orderBy("stimulus_time_s")) - 1).cast("int")
    return frames.withColumns(add) if add else frames


def quality(windowed: DataFrame, keys: list[str], n_nodes: Column | int, least_frames: int = 2) -> DataFrame:
    """One row per window with at least max(2, least_frames) good frames."""
    return windowed.groupBy(*keys).agg(*window_quality(keys, n_nodes)).filter(F.col("n_tr_effective") >= max(2, least_frames))


def pearson_long(samples: DataFrame, keys: list[str], frame: str = "t", node: str = "node_idx", value: str = "x") -> DataFrame:
    """samples(keys, frame, node, value) of good frames -> keys, i, j, n, r for i < j."""
    left = samples.select(*keys, frame, F.col(node).alias("i"), F.col(value).cast("double").alias("x"))
    right = samples.select(*keys, frame, F.col(node).alias("j"), F.col(value).cast("double").alias("y"))
    pairs = left.join(right, [*keys, frame]).filter("i < j")
    return pairs.groupBy(*keys, "i", "j").agg(F.count(F.lit(1)).alias("n"), safe_pearson(F.col("x"), F.col("y")).alias("r")).withColumn("r", clip_r(F.col("r")))


def pearson_upper(x: np.ndarray, kind=np.float32) -> np.ndarray:
    """The row-major upper triangle of the correlation matrix of the columns of x, computed in double; NaN where undefined."""
    n, p = x.shape
    i, j = np.triu_indices(p, 1)
    if n < 2:
        return np.full(len(i), np.nan, kind)
    centred = x - x[0]  # exact zeros for constant columns
    centred = centred - centred.mean(0)
    gram = centred.T @ centred
    scale = np.sqrt(np.diag(gram))
    with np.errstate(invalid="ignore", divide="ignore"):
        r = gram / np.outer(scale, scale)
    return np.clip(r[i, j], -1, 1).astype(kind)


def pearson_packed(windowed: DataFrame, keys: list[str], value: str = "v", double: bool = False) -> DataFrame:
    """windowed(keys, t, good_frame, value array) -> keys and edges (array<float>, or double), from good frames in time order.

    A group is one window of one run: its size is bounded by the window, not by the data."""
    d = windowed.filter("good_frame").select(*keys, "t", value)
    kinds = ", ".join(f"`{k}` {d.schema[k].dataType.simpleString()}" for k in keys)

    def kernel(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("t").to_numpy(), kind="stable")
        x = np.asarray(table.column(value).combine_chunks().flatten(), np.float64).reshape(table.num_rows, -1)[order]
        head = table.slice(0, 1)
        return pa.table([*(head.column(k) for k in keys), pa.array([pearson_upper(x, kind)], pa.list_(pa.from_numpy_dtype(kind)))], names=[*keys, "edges"])

    kind = np.dtype(np.float64 if double else np.float32)
    return d.groupBy(*keys).applyInArrow(kernel, f"{kinds}, edges array<{'double' if double else 'float'}>")


_ENTITIES = ("cohort", "atlas", "task", "sub", "ses", "run", "acq", "run_key")
_FLAGS = "n_tr_available short, n_tr_effective short, frac_good_frames float, start_tr int, start_s float, crosses_run_boundary boolean, crosses_clip_boundary boolean, rank_deficient boolean"


def _spans_of(frames: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """Frames with `spans`, an array of (window_s, duration_s, n_tr_nominal): one entry per window size, so frames don't multiply."""
    packed = spans.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col("window_s").cast("double").alias("window_s"), F.col("duration_s").cast("double").alias("duration_s"), F.col("n_tr_nominal").cast("short").alias("n_tr_nominal")))).alias("spans"))
    return frames.join(small(packed), key)


def _crosses(x: np.ndarray, known: np.ndarray) -> bool:
    x = x[known]
    return bool(len(x)) and x.min() != x.max()


def dfc(activation: DataFrame, spans: DataFrame, overlaps: int = 5, drop_incomplete: bool = True, least_frames: int = 2, double: bool = False) -> DataFrame:
    """Windowed connectivity and quality flags of all runs and window sizes in one plan; one row per window with at least max(2, least_frames) good frames.

    activation: run_key and other key columns, t, stimulus_time_s, v (array) and optional good_frame, run_idx, clip_idx, time_s.
    spans: task or run_key, window_s, duration_s, n_tr_nominal (small: one row per task or run, and window size).

    Frames are grouped by run and shipped once, whatever the windows' sizes and overlaps; windows are slices within the group, which a recording bounds."""
    frames = with_defaults(_spans_of(activation, spans, "run_key" if "run_key" in spans.columns else "task"))
    entities = [c for c in _ENTITIES if c in frames.columns]
    by = [c for c in ("run_key", "atlas") if c in entities]
    kind = np.dtype(np.float64 if double else np.float32)
    d = frames.select(*entities, "t", F.col("stimulus_time_s").cast("double").alias("stimulus_time_s"), F.col("time_s").cast("double").alias("time_s"), F.col("good_frame").cast("boolean").alias("good_frame"), F.col("run_idx").cast("int").alias("run_idx"), F.col("clip_idx").cast("int").alias("clip_idx"), "v", "spans")
    kinds = ", ".join(f"`{c}` {d.schema[c].dataType.simpleString()}" for c in entities)
    schema = f"{kinds}, window_s double, n_tr_nominal short, window_id int, stimulus_start_s float, stimulus_end_s float, {_FLAGS}, edges array<{'double' if double else 'float'}>"
    names = [f.split(" ")[0].strip("`") for f in schema.split(", ")]

    def kernel(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("t")
        head = {c: table.column(c)[0].as_py() for c in entities}
        column = lambda c, fill: table.column(c).fill_null(fill).to_numpy(zero_copy_only=False)
        known = lambda c: table.column(c).is_valid().to_numpy(zero_copy_only=False)
        t, at, time = column("t", 0), column("stimulus_time_s", np.nan), column("time_s", np.nan)
        good, run, clip = column("good_frame", False), column("run_idx", 0), column("clip_idx", 0)
        run_known, clip_known = known("run_idx"), known("clip_idx")
        x = np.asarray(table.column("v").combine_chunks().flatten(), np.float64).reshape(len(t), -1)
        rows: list[tuple] = []
        for span in table.column("spans")[0].as_py():
            width, step = span["window_s"], span["window_s"] / overlaps
            for k in range(grid_size(span["duration_s"], width, overlaps, drop_incomplete)):
                start, end = k * step, k * step + width
                inside = (at >= start - EPS) & (at < end - EPS)
                use = inside & good
                n, n_eff = int(inside.sum()), int(use.sum())
                if n_eff < max(2, least_frames):
                    continue
                first = int(use.argmax())
                flags = (n, n_eff, n_eff / n, int(t[first]), time[first], _crosses(run[inside], run_known[inside]), _crosses(clip[inside], clip_known[inside]), n_eff - 1 < x.shape[1])
                rows.append((width, span["n_tr_nominal"], k, start, end, *flags, pearson_upper(x[use], kind)))
        return pa.Table.from_arrays([*(pa.array([head[c]] * len(rows), t.type) for c, t in zip(entities, table.select(entities).schema, strict=True)), *(pa.array([r[i] for r in rows], pa.from_numpy_dtype(k) if isinstance(k, str) else k) for i, k in enumerate(_kinds(kind)))], names)

    return d.groupBy(*by).applyInArrow(kernel, schema)


def _kinds(edge: np.dtype) -> list:
    """Arrow types of a window's columns, in order."""
    return ["float64", "int16", "int32", "float32", "float32", "int16", "int16", "float32", "int32", "float32", pa.bool_(), pa.bool_(), pa.bool_(), pa.list_(pa.from_numpy_dtype(edge))]


def observed_durations(activation: DataFrame, tr: float) -> DataFrame:
    """run_key, duration_s: the last stimulus time and one frame more, for runs without a configured duration."""
    return activation.groupBy("run_key").agg((F.max("stimulus_time_s").cast("double") + tr).alias("duration_s"))


def unpack(table: DataFrame, n_nodes: int, edges: str = "edges") -> DataFrame:
    """One row per edge: i, j and r in place of the array."""
    e = F.col("e")
    rows = table.select(*[c for c in table.columns if c != edges], F.posexplode(edges).alias("e", "r"))
    n = F.lit(n_nodes)
    i = F.floor(((2 * n - 1) - F.sqrt((2 * n - 1) * (2 * n - 1) - 8 * e)) / 2).cast("int")
    # The square root can be off by one place near a row's end.
    start = lambda k: F.floor(k * (2 * n - k - 1) / 2)
    i = F.when(start(i + 1) <= e, i + 1).when(start(i) > e, i - 1).otherwise(i)
    rows = rows.withColumn("i", i.cast("int"))
    return rows.withColumn("j", (e - start(F.col("i")) + F.col("i") + 1).cast("int")).drop("e")


def edge_names(columns: list[str]) -> list[str]:
    """Names A__B of all edges, in the order of their places."""
    return [f"{a}__{b}" for k, a in enumerate(columns) for b in columns[k + 1 :]]


def widen(table: DataFrame, names: list[str], edges: str = "edges") -> DataFrame:
    """One column per edge, named A__B. Arrow batches are cut into columns, as expressions by the thousand take Spark longer than the data."""
    wide, keep = edge_names(names), [c for c in table.columns if c != edges]
    d = table.select(*keep, edges)
    kind = d.schema[edges].dataType.elementType.simpleString()
    schema = ", ".join([f"`{c}` {d.schema[c].dataType.simpleString()}" for c in keep] + [f"`{c.replace('`', '``')}` {kind}" for c in wide])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(edges).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, len(wide))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *(pa.array(np.ascontiguousarray(x[:, k])) for k in range(len(wide)))], [*keep, *wide])

    return d.mapInArrow(run, schema)


def pack_wide(table: DataFrame, columns: list[str]) -> DataFrame:
    """The packed form of a wide table: `edges` holds `columns` in order; NaN where a stored value is missing."""
    keep = [c for c in table.columns if c not in set(columns)]
    d = table.select(*keep, *[F.col(f"`{c}`") for c in columns])
    kind = d.schema[columns[0]].dataType.simpleString() if columns else "float"
    schema = ", ".join([f"`{c}` {d.schema[c].dataType.simpleString()}" for c in keep] + [f"edges array<{kind}>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.column_stack([b.column(c).fill_null(NAN).to_numpy(zero_copy_only=False) for c in columns]) if columns else np.zeros((b.num_rows, 0), np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * len(columns), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), lists], [*keep, "edges"])

    return d.mapInArrow(run, schema)


def read_edges(table: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """A stored connectivity table of one atlas in packed form, however it was stored. Edge columns go by the atlas's node `columns`, or else are those whose name has __, in their order."""
    if "edges" in table.columns:
        return table
    wanted = edge_names(columns) if columns is not None else [c for c in table.columns if "__" in c]
    if missing := [c for c in wanted if c not in table.columns]:
        raise ValueError(f"{len(missing)} edges are missing, as {', '.join(missing[:3])}")
    return pack_wide(table, wanted)


def edge_storage_mode(n_edges: int, threshold: int = 20_000) -> str:
    return "columns" if n_edges <= threshold else "list"


def full_matrix(edges: DataFrame, keys: list[str], nodes: DataFrame) -> DataFrame:
    """Long edges (keys, i, j, r) and nodes(node_idx) -> all cells of the symmetric matrix, 1.0 on the diagonal."""
    cells = edges.select(*keys, F.explode(F.array(F.struct("i", "j", "r"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), "r"))).alias("c")).select(*keys, "c.*")
    diagonal = edges.select(*keys).distinct().crossJoin(F.broadcast(nodes.select(F.col("node_idx").alias("i"), F.col("node_idx").alias("j"), F.lit(1.0).alias("r"))))
    return cells.unionByName(diagonal)


def max_abs_difference(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The largest difference of two routes to the same values, for each value of the first key. A row that only one of them has, or that only one has as NaN, differs without bound."""
    both = a.select(*keys, F.col(value).alias("_a")).join(b.select(*keys, F.col(value).alias("_b")), keys, "full")
    none = lambda c: F.col(c).isNull() | F.isnan(c)
    d = F.when(F.col("_a").isNull() | F.col("_b").isNull(), float("inf")).when(none("_a") & none("_b"), 0.0).when(none("_a") | none("_b"), float("inf")).otherwise(F.abs(F.col("_a") - F.col("_b")))
    return both.groupBy(keys[0]).agg(F.max(d).alias("max_abs_diff"))
