"""Windows, clocks, censoring, correlation, cleaning and names, property by property."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nodetide.config import ConfigError, config_from_dict
from nodetide.functions import names as N
from nodetide.operators import clean, cohort, connectivity, diagnostics, extract, spatial
from nodetide.plans import grid, timing


def starts(spark, duration, width, overlaps=5, drop=True):
    d = spark.createDataFrame([(float(duration), float(width))], "duration_s double, window_s double")
    return [(r.start_s, r.end_s) for r in grid.stimulus_grid(d, overlaps, drop).orderBy("window_id").collect()]


def test_grid(spark):
    assert [s for s, _ in starts(spark, 90, 15, 3)] == [5.0 * k for k in range(16)]
    assert starts(spark, 29, 30) == []
    assert len(starts(spark, 300, 30)) == 46
    assert [s for s, _ in starts(spark, 300, 30, 7)] == [k * (30 / 7) for k in range(len(starts(spark, 300, 30, 7)))]
    assert len(starts(spark, 12, 30, 5, drop=False)) == 2
    with pytest.raises(ValueError):
        grid.stride(F.lit(1.0), 0)


def test_nominal_frames(spark):
    want = {(30.0, 1.0): 30, (30.0, 1.49): 20, (30.0, 2.0): 15, (30.0, 2.47): 12, (60.0, 1.49): 40, (60.0, 2.47): 24, (120.0, 1.49): 81, (120.0, 2.47): 49, (300.0, 1.49): 201, (300.0, 2.47): 121}
    d = spark.createDataFrame(list(want), "w double, tr double")
    assert {(r.w, r.tr): r.n for r in d.select("w", "tr", grid.nominal_frames(F.col("w"), F.col("tr")).alias("n")).collect()} == want
    with pytest.raises(Exception, match="positive"):
        spark.range(1).select(grid.nominal_frames(F.lit(0.0), F.lit(1.0))).collect()


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(width=st.sampled_from([5.0, 7.5, 30.0]), overlaps=st.integers(1, 7), times=st.lists(st.floats(0, 200, width=32), min_size=1, max_size=30, unique=True))
def test_membership_is_the_exact_predicate(spark, width, overlaps, times):
    step = width / overlaps
    n = 0 if 200 + 1e-9 < width else int(np.floor((200 - width) / step + 1e-9)) + 1
    want = sorted((t, k) for t in times for k in range(n) if k * step - 1e-9 <= t < k * step + width - 1e-9)
    d = spark.createDataFrame([(t, 200.0, width) for t in times], "stimulus_time_s float, duration_s double, window_s double")
    assert sorted((r.stimulus_time_s, r.window_id) for r in grid.assign_windows(d, overlaps=overlaps).collect()) == want


def test_index_windows(spark):
    d = spark.createDataFrame([(100, 30)], "n_tr int, window_tr int")
    assert [r.start_tr for r in grid.index_windows(d).orderBy("window_id").collect()] == list(range(0, 71, 6))
    with pytest.raises(Exception, match="at least 2"):
        grid.index_windows(spark.createDataFrame([(100, 1)], "n_tr int, window_tr int")).collect()


def test_grid_table_function(spark):
    grid.register_grid_function(spark)
    assert spark.sql("SELECT count(*), max(start_s) FROM stimulus_windows(240.0D, 30.0D, 5)").first()[:] == (36, 210.0)


def test_segments(spark):
    runs = spark.createDataFrame([("r", 80, 1.0), ("q", 3, 2.0)], "run_key string, n_tr int, tr double")
    seg = spark.createDataFrame([("r", 0, 50, 0.0), ("r", 1, 30, 50.0)], "run_key string, seg_idx int, n_vols int, stimulus_offset_s double")
    axis = timing.build_time_axis(runs, seg, "from_scans")
    got = {(r.run_key, r.t): (r.stimulus_time_s, r.run_idx) for r in axis.collect()}
    assert len(got) == 83 and got["r", 49] == (49.0, 0) and got["r", 50] == (50.0, 1) and got["q", 2] == (4.0, 0)
    with pytest.raises(Exception, match="sum"):
        timing.build_time_axis(runs.filter("run_key='r'"), seg.filter("seg_idx=0")).collect()
    with pytest.raises(ValueError):
        timing.build_time_axis(runs, None, "guess")


def test_scans(spark):
    kind = "run_key string, seg_idx int, acq_s double, n_vols int, tr double"
    s = spark.createDataFrame([("r", 0, 0.0, 300, 1.0), ("r", 1, 375.0, 300, 1.0), ("r", 2, 3815.0, 200, 1.0)], kind)
    assert [r.stimulus_offset_s for r in timing.segments_from_scans(s).orderBy("seg_idx").collect()] == [0.0, 300.0, 600.0]
    with pytest.raises(Exception, match="negative gap"):
        timing.segments_from_scans(spark.createDataFrame([("r", 0, 0.0, 300, 1.0), ("r", 1, 100.0, 300, 1.0)], kind)).collect()


def bad(spark, n, censored, k):
    axis = spark.createDataFrame([("r", t) for t in range(n)], "run_key string, t int")
    c = spark.createDataFrame([("r", t) for t in censored], "run_key string, t int")
    return sorted(r.t for r in timing.censor_mask(axis, c, dilate_tr=k).filter("NOT good_frame").collect())


def test_dilation_does_not_wrap(spark):
    assert bad(spark, 10, [5], 1) == [4, 5, 6]
    assert bad(spark, 5, [0], 1) == [0, 1]
    assert bad(spark, 5, [4, 99], 0) == [4]


def test_trim(spark):
    d = spark.createDataFrame([("r", t, 10.0, 2.0, 20) for t in range(20)], "run_key string, t int, trim_end_s double, tr double, n_tr int")
    assert timing.trim(d).count() == 5 and timing.trim(d, mode="both").count() == 5 and timing.trim(d, mode="start").count() == 20
    with pytest.raises(Exception, match="longer"):
        timing.trim(d.withColumn("trim_end_s", F.lit(99.0))).collect()
    # Frames as the unit are converted once: 10 frames of 2 s stay 10 frames.
    runs = spark.createDataFrame([("a", "t")], "sub string, task string")
    people = spark.createDataFrame([("p", "a", "c", "t", False, 10.0)], "participant_id string, sub string, cohort string, task string, excluded boolean, end double")
    assert cohort.attach_participants(runs, people, "end", "tr", 2.0).first().trim_end_s == 20.0


def test_pearson_against_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(100, 1, (60, 5))
    x[:, 3] = 7.1
    x[10, 4] = np.nan
    i, j = np.triu_indices(5, 1)
    with np.errstate(all="ignore"):
        want = np.corrcoef(x.T)[i, j]
    want[(i == 3) | (j == 3)] = np.nan
    assert np.allclose(connectivity.pearson_upper(x), want, atol=1e-6, equal_nan=True)
    assert np.isnan(connectivity.pearson_upper(x[:1])).all()
    assert np.allclose(connectivity.pearson_upper(3 * x + 8), want, atol=1e-6, equal_nan=True)
    f = spark.createDataFrame([("r", t, True, [float(v) for v in x[t]]) for t in range(60)], "run_key string, t int, good_frame boolean, v array<double>")
    packed = connectivity.unpack(connectivity.pearson_packed(f, ["run_key"]), 5).orderBy("i", "j").collect()
    assert [(r.i, r.j) for r in packed] == list(zip(i.tolist(), j.tolist()))
    assert np.allclose([r.r for r in packed], want, atol=1e-6, equal_nan=True)
    long = connectivity.pearson_long(extract.to_long(f), ["run_key"]).orderBy("i", "j").collect()
    assert np.allclose([r.r for r in long], want, atol=1e-9, equal_nan=True)
    wide = connectivity.widen(connectivity.pearson_packed(f, ["run_key"]), list("abcde"))
    assert wide.columns[1:] == [f"{a}__{b}" for k, a in enumerate("abcde") for b in "abcde"[k + 1 :]]


def test_deletion_beats_zero_filling(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(100, 1, (120, 3))
    drop = rng.choice(120, 24, replace=False)
    zero = x.copy()
    zero[drop] = 0
    keep = np.setdiff1d(np.arange(120), drop)
    assert connectivity.pearson_upper(zero).mean() > 0.6 and abs(connectivity.pearson_upper(x[keep]).mean()) < 0.2


def test_window_flags(spark):
    f = spark.createDataFrame([("r", "m", t, float(t), t not in (3, 4), 0 if t < 100 else 1, [float(t % 7), float(t % 5), 1.0]) for t in range(200)], "run_key string, task string, t int, stimulus_time_s float, good_frame boolean, run_idx int, v array<float>").withColumn("run_idx", F.col("run_idx").cast("byte"))
    spans = spark.createDataFrame([("m", 30.0, 200.0, 30)], "task string, window_s double, duration_s double, n_tr_nominal int")
    out = {r.window_id: r for r in connectivity.dfc(f, spans).collect()}
    assert len(out) == 29 and out[0].n_tr_available == 30 and out[0].n_tr_effective == 28
    assert out[13].crosses_run_boundary and not out[0].crosses_run_boundary and not out[0].crosses_clip_boundary
    assert not out[0].rank_deficient and np.isnan(out[0].edges[1]) and len(out[0].edges) == 3
    late = f.filter("t >= 60")
    ids = {r.window_id for r in connectivity.dfc(late, spans).collect()}
    assert ids and ids <= set(out) and min(ids) > 0
    assert connectivity.edge_storage_mode(6105) == "columns" and connectivity.edge_storage_mode(499500) == "list"


def test_names(spark):
    d = spark.createDataFrame([(" Left Heschl's Gyrus (a), b/c ",)], "s string")
    r = d.select(N.clean_name(F.col("s")), N.hemisphere(F.trim("s")), N.hemisphere_stem(F.trim("s"))).first()
    assert r[:] == ("Left_Heschls_Gyrus_a_b-c", "L", "Heschl's Gyrus (a), b/c")
    one = spark.range(1)
    keys = one.select(N.run_key(F.lit("c"), F.lit("01"), F.lit("m"), F.lit(""), F.lit(None).cast("string"), F.lit("x")), N.leaf_name(F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string")), N.window_key(F.lit(30.0)), N.window_key(F.lit(2.5)), N.path_key(F.lit("a/b=c d"))).first()
    assert keys[:] == ("cohort-c_sub-01_task-m_acq-x", "data.parquet", "30", "2.5", "a-b-c-d")


def test_cleaning():
    t = np.arange(400)
    slow, fast = np.sin(2 * np.pi * t / 20), np.sin(2 * np.pi * t / 3)
    y = clean.band_pass((5 + 0.02 * t + slow + fast)[:, None], 0.02, 0.1, 1.0)[:, 0]
    assert np.corrcoef(y[50:-50], slow[50:-50])[0, 1] > 0.98 and abs(np.corrcoef(y[50:-50], fast[50:-50])[0, 1]) < 0.05
    b, a = clean.butterworth(0.02, 0.1, 1.0)
    gain = lambda f: abs(np.polyval(b, np.exp(2j * np.pi * f)) / np.polyval(a, np.exp(2j * np.pi * f)))
    assert abs(gain(0.02) - 2**-0.5) < 1e-6 and abs(gain(0.1) - 2**-0.5) < 1e-6 and gain(0.3) < 1e-3
    x = np.column_stack((slow + 3 * fast, np.full(400, np.nan)))
    out = clean.clean_matrix(x, np.column_stack((fast, t)), None, None, 1.0, True, True)
    assert abs(out[:, 0] @ fast) < 1e-6 and abs(out[:, 0].std(ddof=1) - 1) < 1e-9 and np.isnan(out[:, 1]).all()


def test_spheres_keep_duplicates(spark):
    points = spark.createDataFrame([(i, float(i), 0.0, 0.0) for i in range(10)], "vox_id long, x double, y double, z double")
    seeds = spark.createDataFrame([(0, 0, 2.0, 0.0, 0.0), (1, 0, 3.0, 0.0, 0.0), (2, 1, 50.0, 0.0, 0.0)], "seed_idx int, node_idx int, sx double, sy double, sz double")
    got = sorted(r.vox_id for r in spatial.sphere_membership(points, seeds, 2.0).collect())
    assert got == [0, 1, 1, 2, 2, 3, 3, 4, 4, 5]
    vox = spark.createDataFrame([("r", 0, i, float(i)) for i in range(10)], "run_key string, t int, vox_id long, v double")
    v = extract.node_means(vox, spatial.sphere_membership(points, seeds, 2.0), 3).first().v
    assert v[0] == 2.5 and np.isnan(v[1]) and np.isnan(v[2])


def test_merge_plan_and_paint(spark):
    cort = spark.createDataFrame([(0, "Background"), (1, "a"), (2, "b")], "id int, name string")
    sub = spark.createDataFrame([(0, "Background"), (1, "Left Cerebral Cortex"), (2, "Thal"), (3, "Put")], "id int, name string")
    plan = spatial.merge_plan(cort, sub)
    assert [(r.part, r.old_id, r.new_id) for r in plan.orderBy("new_id").collect()] == [("cort", 1, 1), ("cort", 2, 2), ("sub", 2, 3), ("sub", 3, 4)]
    c = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (3, 2)], "vox_id int, label int")
    s = spark.createDataFrame([(0, 2), (1, 1), (2, 3), (3, 0)], "vox_id int, label int")
    assert [r.label for r in spatial.merge_labels(c, s, plan).orderBy("vox_id").collect()] == [3, 2, 4, 2]


def test_cohort_problems(spark):
    runs = spark.createDataFrame([("1", "m", None), ("2", "m", None), ("7", "m", None), ("7", "m", None)], "sub string, task string, ses string")
    people = spark.createDataFrame([("a", "1", "c", "m", False, None), ("b", "2", "c", "m", True, None), ("d", "3", "x", "m", False, None), ("e", "3", "c", "m", False, None)], "participant_id string, sub string, cohort string, task string, excluded boolean, exclusion_reason string")
    found = cohort.problems(runs, people, "c", 1.0, {})
    assert [r.check for r in found.collect()] == [1, 2, 3, 4, 5, 7, 8]
    with pytest.raises(cohort.ValidationError):
        cohort.validate(found)
    assert len(cohort.validate(found, strict=False)) == 7
    assert [r.sub for r in cohort.attach_participants(runs, people).collect()] == ["1"]
    with pytest.raises(Exception, match="not a boolean"):
        spark.range(1).select(cohort.strict_boolean(F.lit("maybe"))).collect()


def test_isc_finds_the_shift(spark):
    rng = np.random.default_rng(2)
    base = np.cumsum(rng.normal(size=220))
    rows = [(s, s, "m", t, float(base[t + (2 if s == "3" else 0)] + rng.normal() * 0.1)) for s in ("0", "1", "2", "3") for t in range(200)]
    d = spark.createDataFrame(rows, "run_key string, sub string, task string, t int, x double")
    got = {r.sub: r.best_lag_tr for r in diagnostics.isc_alignment(d).collect()}
    assert got["3"] in (1, 2) and abs(got["0"]) <= 1
    assert diagnostics.isc_gate(diagnostics.isc_alignment(d.filter("sub < '2'"))).first().status == "skipped"


def test_config():
    base = {"cohort": "c", "tr": 1.49, "derivatives_root": "/d", "output_root": "/o"}
    cfg = config_from_dict(base)
    assert cfg.window_tr(30) == 20 and len(cfg.hash()) == 16 and cfg.hash() != config_from_dict(base | {"tr": 2}).hash()
    for bad_one in (base | {"nope": 1}, base | {"windows": {"nope": 1}}, {"cohort": "c"}, base | {"tr": 0}, base | {"atlases": []}, base | {"trim": {"column": "x", "unit": "min"}}):
        with pytest.raises(ConfigError):
            config_from_dict(bad_one)
    with pytest.raises(ConfigError):
        cfg.stimulus_duration_s("m")
    assert cfg.stimulus_duration_s("m", 5) == 5.0


def test_stream_counts_windows(spark, tmp_path):
    from nodetide.streaming.windows import window_quality_stream

    d = spark.range(120).select(F.timestamp_seconds(F.col("id")).alias("ts"), F.lit("r").alias("run_key"), (F.col("id") % 10 != 0).alias("good_frame"))
    d.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(d.schema).parquet(f"{tmp_path}/in")
    q = window_quality_stream(stream, ["run_key"], 30.0).writeStream.format("memory").queryName("windows").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    got = {r.window_id: (r.n_tr_available, r.n_tr_effective) for r in spark.table("windows").collect()}
    assert got[0] == (30, 27) and min(got) == 0
    assert got == {r.window_id: (r.n_tr_available, r.n_tr_effective) for r in window_quality_stream(d, ["run_key"], 30.0).collect()}


def test_offsets_count_the_volumes_that_stay(spark):
    s = spark.createDataFrame([("r", 0, 0.0, 300, 2.0), ("r", 1, 700.0, 100, 2.0), ("r", 2, 1000.0, 50, 2.0)], "run_key string, seg_idx int, acq_s double, n_vols int, tr double")
    got = [(r.n_vols, r.stimulus_offset_s) for r in timing.segments_from_scans(s, 4).orderBy("seg_idx").collect()]
    assert got == [(300, 0.0), (96, 600.0), (46, 792.0)]


def test_first_participant_row_decides(spark):
    from nodetide.operators import cohort

    runs = spark.createDataFrame([("1", "a"), ("2", "a"), ("3", "a")], "sub string, task string")
    people = spark.createDataFrame([("z", "1", "a", True, 0), ("b", "1", "a", False, 1), ("y", "2", "a", False, 2), ("c", "2", "a", True, 3), ("d", "3", "a", None, 4)], "participant_id string, sub string, task string, excluded boolean, row_no long")
    got = cohort.attach_participants(runs, people.withColumn("cohort", people.task))
    assert sorted((r["sub"], r["participant_id"]) for r in got.collect()) == [("2", "y"), ("3", "d")] and "row_no" not in got.columns


def test_shards_split_rows_in_order(spark):
    from nodetide.operators import cohort

    rows = spark.range(0, 1000, 3).selectExpr("id", "(id * 7919) % 1009 AS k").repartition(7)
    order = [r.id for r in rows.orderBy("k", "id").collect()]
    for i in range(4):
        assert sorted(r.id for r in cohort.shard(rows, i, 4, ["k", "id"]).collect()) == sorted(order[i::4])
    assert cohort.shard(rows.limit(0), 0, 2, ["k"]).count() == 0


def test_merged_and_named_atlases(spark, tmp_path):
    import numpy as np

    from nodetide.sources import nifti
    from nodetide.sources.atlas import get_atlas

    cort = np.zeros((6, 4, 4), np.int16)
    cort[:3], cort[3:] = 1, 2
    inner = np.zeros((3, 2, 2), np.int16)  # voxels of twice the size
    inner[1], inner[2, 0, 0] = 2, 1
    put = lambda name, x, size: (tmp_path / name).write_bytes(nifti.encode(x, np.diag([size, size, size, 1.0])))
    put("c.nii", cort, 1.0)
    put("s.nii", inner, 2.0)
    put("y.nii", cort[..., None], 1.0)
    (tmp_path / "c.csv").write_text("id,name\n0,Background\n1,Left Front\n2,Right Front\n")
    (tmp_path / "s.csv").write_text("id,name\n0,Background\n1,Left Cerebral Cortex\n2,Brain Stem\n")
    files = {"cort_image": f"{tmp_path}/c.nii", "sub_image": f"{tmp_path}/s.nii", "cort_labels": f"{tmp_path}/c.csv", "sub_labels": f"{tmp_path}/s.csv"}
    at = np.floor(np.indices(cort.shape) / 2 + 0.5).astype(int)
    ok = (at < np.array(inner.shape)[:, None, None, None]).all(0)
    near = np.where(ok, inner[tuple(np.minimum(at, np.array(inner.shape)[:, None, None, None] - 1))], 0)
    for name, drop in (("HO", (1,)), ("legacy69", ())):
        a = get_atlas(spark, name, **files)
        want = cort.astype(int)
        want[near == 2] = 3 if drop else 4
        if not drop:
            want[near == 1] = 3
        got = np.zeros(cort.size, int)
        index = {r.node_idx: r["index"] for r in a.nodes.collect()}
        for r in a.membership.collect():
            got[r.vox_id] = index[r.node_idx]
        assert (got == want.ravel()).all() and a.n_nodes == (3 if drop else 4) and a.name == ("harvardoxford" if drop else "harvardoxford69")
        assert {r.network for r in a.nodes.collect()} == {"cortical", "subcortical"}
    yeo = get_atlas(spark, "yeo", label_image=f"{tmp_path}/y.nii")
    assert yeo.columns()[:2] == ["Visual", "Somatomotor"] and yeo.n_nodes == 7
    with pytest.raises(KeyError, match="aren't part"):
        get_atlas(spark, "harvard_oxford")
    with pytest.raises(KeyError, match="unknown"):
        get_atlas(spark, "nowhere")


def test_discovery_by_bids_names(spark, tmp_path):
    from nodetide.config import config_from_dict
    from nodetide.sources import tables

    for f in ("sub-01/ses-2/func/sub-01_ses-2_task-walk_acq-hi_run-03_bold.nii.gz", "sub-01/x/sub-02_task-rest_bold.nii.gz", "deep/er/still/sub-03_task-walk_desc-x_bold.nii.gz", "sub-04_task-walk_bold.nii", "sub-05_bold.nii.gz"):
        p = tmp_path / f
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"x")
    cfg = config_from_dict({"cohort": "c", "tr": 1.0, "derivatives_root": str(tmp_path), "output_root": "/o", "discovery": {"backend": "pybids"}})
    assert [(r.sub, r.task, r.ses, r.run, r.acq, r.mask) for r in tables.discover(spark, cfg).collect()] == [("03", "walk", None, None, None, None), ("01", "walk", "2", "03", "hi", None)]
