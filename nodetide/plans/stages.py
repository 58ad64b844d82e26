"""The stages from recordings to connectivity, each one lazy plan over all runs, written once.

A run that fails a check is set aside before the plan runs and reported in the manifest; Spark's own failures stop the stage.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodetide.config import CohortConfig
from nodetide.functions.names import run_key
from nodetide.operators import clean, cohort, connectivity, diagnostics, extract
from nodetide.plans import timing
from nodetide.sources import nifti, storage, tables
from nodetide.sources.atlas import Atlas, get_atlas
from nodetide.sources.storage import ManifestEntry


def planned_runs(spark: SparkSession, cfg: CohortConfig, strict: bool = True) -> tuple[DataFrame, list[str]]:
    """Discovered runs with their participants' columns, run keys and censor files, and the problems found."""
    runs = tables.discover(spark, cfg)
    found: list[str] = []
    if cfg.participants:
        people = tables.participants(spark, cfg.participants)
        found = cohort.validate(cohort.problems(runs, people, cfg.cohort, cfg.tr, cfg.stimulus.durations_s, cfg.trim.column, cfg.trim.unit), strict)
        runs = cohort.attach_participants(runs, people, cfg.trim.column, cfg.trim.unit, cfg.tr)
    if "trim_end_s" not in runs.columns:
        runs = runs.withColumn("trim_end_s", F.lit(None).cast("double"))
    runs = runs.withColumn("run_key", run_key(*[F.col(c) for c in ("cohort", "sub", "task", "ses", "run", "acq")]))
    if cfg.confounds.censor_glob:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", cfg.confounds.censor_glob).load(cfg.derivatives_root).select(F.regexp_replace("path", "^file:/+", "/").alias("path"))
        found_files = tables.discover_from_paths(files, cfg).select(F.col("path").alias("file"), "sub", "task", "ses", "run", "acq")
        runs = cohort.attach_by_entities(runs, found_files, "file", "censor")
    else:
        runs = runs.withColumn("censor", F.lit(None).cast("string"))
    return runs, found


def _existing(spark: SparkSession, cfg: CohortConfig, stage: str) -> DataFrame | None:
    path = f"{cfg.output_root.rstrip('/')}/{stage}"
    return storage.open_stage(spark, cfg.output_root, stage) if storage.exists(spark, path) else None


def activation(spark: SparkSession, cfg: CohortConfig, runs: DataFrame, atlas: Atlas, segments: DataFrame | None = None) -> DataFrame:
    """The activation table of all `runs` (path, run_key, n_tr, ...) for one atlas."""
    means = nifti.node_means(runs, atlas.membership, atlas.n_nodes)
    f = cfg.filtering
    low, high = (f.bandpass or (None, None)) if not f.already_applied else (None, None)
    means = clean.clean_runs(means, cfg.tr, None, low, high, f.detrend, f.standardize)
    axis = timing.build_time_axis(runs.select("run_key", "n_tr", F.lit(float(cfg.tr)).alias("tr")), segments, cfg.stimulus.timing_source)
    axis = timing.censor_mask(axis, None, kept_frames(spark, runs), cfg.confounds.dilate_tr)
    table = extract.activation_table(means, axis, runs.withColumn("atlas", F.lit(atlas.name)), passed_on(runs))
    limits = runs.select("run_key", "n_tr", "trim_end_s").withColumn("tr", F.lit(float(cfg.tr)))
    return timing.trim(table.join(extract.small(limits), "run_key"), mode=cfg.trim.mode).select(*table.columns)


def passed_on(runs: DataFrame) -> list[str]:
    """Columns of the participants table that the activation table carries on."""
    own = {"path", "mask", "censor", "t", "n_tr", "shape", "trim_end_s", "timing_source", "excluded", "exclusion_reason", "detail", "row_no", *extract.COLUMNS}
    return [c for c in runs.columns if c not in own]


def kept_frames(spark: SparkSession, runs: DataFrame) -> DataFrame | None:
    """run_key, t, keep of the runs that have a censor file."""
    files = [r.censor for r in runs.select("censor").distinct().collect() if r.censor]  # file names
    if not files:
        return None
    return tables.censor(spark, files).join(extract.small(runs.select("run_key", F.col("censor").alias("path"))), "path").select("run_key", "t", "keep")


def _shapes(paths: DataFrame, column: str) -> DataFrame:
    """`column`, n_tr and shape (i,j,k) from the headers of images; n_tr is 0 for 3D and -1 for unreadable ones."""
    def read(batches):
        for frame in batches:
            n, shapes = [], []
            for p in frame[column]:
                try:
                    with nifti._open(p) as f:
                        shape = nifti.parse_header(f.read(352)).shape
                    n.append(shape[3] if len(shape) == 4 else 0)
                    shapes.append(",".join(map(str, shape[:3])))
                except (OSError, ValueError, EOFError):
                    n.append(-1)
                    shapes.append(None)
            yield frame.assign(n_tr=n, shape=shapes)

    return paths.select(column).filter(F.col(column).isNotNull()).distinct().mapInPandas(read, f"{column} string, n_tr int, shape string")


def with_lengths(spark: SparkSession, runs: DataFrame) -> DataFrame:
    """Runs with n_tr and shape, from the headers of their files."""
    sizes = _shapes(runs, "path").withColumn("n_tr", F.when(F.col("n_tr") > 0, F.col("n_tr")).otherwise(-1))
    return runs.join(sizes, "path")


def set_aside(spark: SparkSession, cfg: CohortConfig, runs: DataFrame, segments: DataFrame | None = None) -> DataFrame:
    """Runs with `detail`: why a run can't be extracted, or null."""
    d = runs.join(_shapes(runs, "mask").select("mask", F.col("shape").alias("_mask_shape")), "mask", "left")
    twice = storage.shared_leaves(runs).withColumn("_twice", F.lit(True))
    d = d.join(twice, "run_key", "left")
    keep = kept_frames(spark, runs)
    rows = timing.check_censor_length(keep, runs.select("run_key", "n_tr")).select("run_key", F.col("n_rows").alias("_rows")) if keep is not None else None
    d = d.join(rows, "run_key", "left") if rows is not None else d.withColumn("_rows", F.lit(None).cast("long"))
    vols = segments.groupBy("run_key").agg(F.sum("n_vols").alias("_vols")) if segments is not None else None
    d = d.join(vols, "run_key", "left") if vols is not None else d.withColumn("_vols", F.lit(None).cast("long"))
    wrong = (
        F.when(F.col("n_tr") < 0, "not a readable 4D image")
        .when(F.bround(F.col("trim_end_s") / cfg.tr) > F.col("n_tr"), "trim is longer than the run")
        .when(F.col("_rows").isNotNull(), F.concat(F.lit("the censor file has "), F.col("_rows"), F.lit(" rows for "), F.col("n_tr"), F.lit(" frames")))
        .when(F.col("mask").isNotNull() & ~F.col("_mask_shape").eqNullSafe(F.col("shape")), F.concat(F.lit("the mask's shape is "), F.coalesce("_mask_shape", F.lit("unreadable")), F.lit(", the image's "), F.col("shape")))
        .when(F.col("_twice"), "shares its path with another run")
        .when(F.col("_vols") != F.col("n_tr"), F.concat(F.lit("segments sum to "), F.col("_vols"), F.lit(" frames of "), F.col("n_tr")))
    )
    return d.withColumn("detail", wrong).select(*runs.columns, "detail")


def segments_of(runs: DataFrame, scans: DataFrame, tr: float) -> DataFrame:
    """Segments (run_key, seg_idx, n_vols, stimulus_offset_s) of the runs whose subject and task have scans, in the order of their runs. What the first scan says of drop_after_restart holds for all."""
    from pyspark.sql import Window as W

    order = W.partitionBy("run_key").orderBy("scan_run")
    rows = runs.select("run_key", "sub", "task").join(scans.select("sub", "task", F.col("run").alias("scan_run"), "acq_s", "n_vols", "drop_after_restart"), ["sub", "task"])
    rows = rows.withColumns({"seg_idx": (F.row_number().over(order) - 1).cast("int"), "drop": F.first("drop_after_restart").over(order), "tr": F.lit(float(tr))})
    return timing.segments_from_scans(rows, F.col("drop"))


def extract_stage(spark: SparkSession, cfg: CohortConfig, strict: bool = True, shard: tuple[int, int] | None = None, overwrite: bool = False, limit: int | None = None, scans: str | None = None) -> list[ManifestEntry]:
    """Extracts what isn't done; each run is written to a leaf of its own. `scans` names a table of the scans that runs are made of."""
    runs, _ = planned_runs(spark, cfg, strict)
    if limit:
        runs = runs.orderBy("path").limit(limit)
    runs = with_lengths(spark, runs)
    segments = segments_of(runs, tables.scans(spark, scans), cfg.tr) if scans else None
    runs = set_aside(spark, cfg, runs, segments).cache()
    done = _existing(spark, cfg, "activation")
    entries: list[ManifestEntry] = []
    for name in cfg.atlases:
        atlas = get_atlas(spark, name, **cfg.atlas_params.get(name, {}))
        if shard is None or shard[0] == 0:
            storage.write_labels(atlas.nodes, cfg.output_root, name)
        mine = cohort.shard(runs, *shard, ["path"]) if shard else runs
        mine = mine.withColumn("atlas", F.lit(name))
        todo = storage.pending(mine, done.filter(F.col("atlas") == storage.key_text(name)) if done is not None else None, ["run_key"], overwrite).cache()
        # Read before the write: writing to the stage refreshes what was cached from it.
        new = {r.run_key: r.detail for r in todo.select("run_key", "detail").collect()}  # one row a run
        if any(v is None for v in new.values()):
            good = todo.filter("detail IS NULL").drop("atlas", "detail")
            storage.write_stage(activation(spark, cfg, good, atlas, segments), cfg.output_root, "activation")
        root = storage.stage_root(cfg.output_root, "activation", name, cohort=cfg.cohort)
        leaves = mine.withColumn("leaf", storage.leaf_of(mine))
        for r in leaves.select("run_key", "task", "sub", "leaf", "n_tr").collect():
            status = "skipped" if r.run_key not in new else "error" if new[r.run_key] else "ok"
            entries.append(ManifestEntry("activation", cfg.cohort, name, r.task, r.sub, f"{root}/task={storage.key_text(r.task)}/sub={storage.key_text(r.sub)}/leaf={r.leaf}", status, r.n_tr if status == "ok" else 0, None, new.get(r.run_key) or ""))
        todo.unpersist()
    runs.unpersist()
    storage.write_manifest(spark, cfg.output_root, entries, cfg.to_dict(), storage.manifest_name("activation", shard), cfg.cohort)
    return entries


def dfc_stage(spark: SparkSession, cfg: CohortConfig, sizes_s: list[float] | None = None, shard: tuple[int, int] | None = None, overwrite: bool = False) -> list[ManifestEntry]:
    """All window sizes of all runs of an atlas in one plan over one scan of its activation table. Up to windows.edge_column_threshold edges are stored as columns, more as an array."""
    sizes = [float(s) for s in (sizes_s or cfg.windows.sizes_s)]
    entries: list[ManifestEntry] = []
    for name in cfg.atlases:
        act = storage.open_stage(spark, cfg.output_root, "activation", root=storage.stage_root(cfg.output_root, "activation", name, cohort=cfg.cohort))
        if shard:
            mine = cohort.shard(act.select("run_key").distinct(), *shard, ["run_key"])
            act = act.join(extract.small(mine), "run_key", "left_semi")
        runs = act.select("run_key", "task", "sub", "leaf").distinct()
        known = spark.createDataFrame(list(cfg.stimulus.durations_s.items()) or [("", 0.0)], "task string, known double")
        durations = runs.join(F.broadcast(known), "task", "left").join(connectivity.observed_durations(act, cfg.tr), "run_key").select("run_key", "task", "sub", "leaf", F.coalesce("known", "duration_s").alias("duration_s"))
        planned = durations.withColumn("window_s", F.explode(F.array(*map(F.lit, sizes)))).withColumn("n_tr_nominal", F.floor(F.col("window_s") / cfg.tr + 0.5).cast("int"))
        done = _existing(spark, cfg, "dfc")
        done = done.filter(F.col("atlas") == storage.key_text(name)).select("run_key", F.col("window_s").cast("double").alias("window_s")) if done is not None else None
        todo = storage.pending(planned, done, ["run_key", "window_s"], overwrite).cache()
        # Read before the write: writing to the stage refreshes what was cached from it.
        new = {(r.run_key, r.window_s) for r in todo.select("run_key", "window_s").collect()}  # one row a run and size
        counts: dict = {}
        if new:
            w = cfg.windows
            out = connectivity.dfc(act, todo.select("run_key", "window_s", "duration_s", "n_tr_nominal"), w.n_overlaps, w.drop_incomplete, w.min_n_tr_effective)
            columns = [r["column"] for r in get_atlas(spark, name, **cfg.atlas_params.get(name, {})).nodes.orderBy("node_idx").select("column").collect()]  # a row for each node
            if connectivity.edge_storage_mode(len(columns) * (len(columns) - 1) // 2, w.edge_column_threshold) == "columns":
                out = connectivity.widen(out, columns)
            storage.write_stage(out, cfg.output_root, "dfc")
            written = storage.open_stage(spark, cfg.output_root, "dfc", root=storage.stage_root(cfg.output_root, "dfc", name))
            counts = {(r.run_key, float(r.window_s)): r["count"] for r in written.groupBy("run_key", "window_s").count().collect()}
        for r in planned.select("run_key", "task", "sub", "leaf", "window_s").collect():
            n = counts.get((r.run_key, r.window_s), 0)
            status = "skipped" if (r.run_key, r.window_s) not in new else "ok" if n else "empty"
            root = storage.stage_root(cfg.output_root, "dfc", name, r.window_s, cfg.cohort)
            entries.append(ManifestEntry("dfc", cfg.cohort, name, r.task, r.sub, f"{root}/task={storage.key_text(r.task)}/sub={storage.key_text(r.sub)}/leaf={r.leaf}", status, n if status == "ok" else 0, r.window_s, "" if n or status == "skipped" else "no window has enough good frames"))
        todo.unpersist()
    storage.write_manifest(spark, cfg.output_root, entries, cfg.to_dict(), storage.manifest_name("dfc", shard), cfg.cohort)
    return entries


def read_edges(spark: SparkSession, output_root: str, atlas: str, window_s: float | None = None, columns: list[str] | None = None) -> DataFrame:
    """The connectivity of one atlas (and window size) in packed form, however it is stored."""
    return connectivity.read_edges(storage.open_stage(spark, output_root, "dfc", root=storage.stage_root(output_root, "dfc", atlas, window_s)), columns)


def diagnose_stage(spark: SparkSession, cfg: CohortConfig, isc_nodes: list[str] | None = None, atlas: str | None = None) -> str:
    """Writes coverage, left-right and alignment tables; the gate's status: passed, failed or skipped."""
    name = atlas or cfg.atlases[0]
    act = storage.open_stage(spark, cfg.output_root, "activation").filter((F.col("atlas") == storage.key_text(name)) & (F.col("cohort") == storage.key_text(cfg.cohort))).cache()
    storage.write_diagnostic(diagnostics.coverage(act), cfg.output_root, "coverage.parquet", cfg.cohort)
    a = get_atlas(spark, name, **cfg.atlas_params.get(name, {}))
    storage.write_diagnostic(diagnostics.left_right(act, a.nodes), cfg.output_root, "lr_correlation.csv", cfg.cohort)
    columns = a.columns()
    at = [columns.index(c) for c in (isc_nodes or columns[:1])]
    x = reduce(lambda p, q: p + q, [F.get("v", F.lit(i)).cast("double") for i in at]) / len(at)
    isc = diagnostics.isc_alignment(act.select("run_key", "sub", "task", "t", x.alias("x"))).cache()
    storage.write_diagnostic(isc, cfg.output_root, "isc.csv", cfg.cohort)
    status = diagnostics.isc_gate(isc, cfg.stimulus.isc_gate_tr).first().status
    isc.unpersist()
    act.unpersist()
    return status
