"""The stages and commands on a synthetic cohort."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nodetide import cli
from nodetide.config import load_config
from nodetide.operators import connectivity
from nodetide.plans import stages
from nodetide.sources import fixture, nifti, storage, tables
from nodetide.sources.fixture import make_fixture


@pytest.fixture(scope="module")
def cohort(spark, tmp_path_factory):
    made = make_fixture(tmp_path_factory.mktemp("cohort") / "f", n_subs=3, n_tr=120)
    cfg = load_config(made["config"])
    first = stages.extract_stage(spark, cfg)
    dfc = stages.dfc_stage(spark, cfg)
    return made, cfg, first, dfc


def test_all_runs_are_written(cohort):
    _, _, act, dfc = cohort
    assert [(e.status, e.n_rows) for e in act] == [("ok", 120)] * 6
    assert {e.path.rsplit("/", 1)[1] for e in act} == {"leaf=data"}
    assert sorted((e.window_s, e.n_rows) for e in dfc if e.atlas == "fixture_labels")[:1][0][0] == 30.0
    assert {e.status for e in dfc} == {"ok"}


def test_activation(spark, cohort):
    made, cfg, _, _ = cohort
    act = storage.open_stage(spark, cfg.output_root, "activation").filter("atlas = 'fixture_labels'")
    assert {r.sub for r in act.select("sub").distinct().collect()} == {"01", "02", "03"} and act.count() == 360
    assert {(r["participant_id"], r["group"]) for r in act.select("participant_id", "group").distinct().collect()} == {("walker01", "west"), ("walker02", "east"), ("walker03", "west")}
    one = act.filter("sub = '01'").orderBy("t").collect()
    stem = f"{made['root']}/derivatives/sub-01/func/sub-01_task-walk"
    keep = [int(x) for x in open(f"{stem}_censor.1D")]
    want = [all(keep[max(0, t - 1) : t + 2]) for t in range(120)]
    assert [r.good_frame for r in one] == want and 90 < sum(want) < 110
    head, data = nifti.decode(open(f"{stem}_bold.nii.gz", "rb").read())
    _, labels = nifti.decode(open(f"{made['root']}/octants.nii.gz", "rb").read())
    mean = np.array([data[labels == p + 1].mean(0, dtype=float) for p in range(8)]).T
    assert np.abs(np.array([r.v for r in one]) - mean).max() < 1e-3 and head.shape == (*fixture.BOX, 120)


def test_connectivity_shows_the_planted_groups(spark, cohort):
    _, cfg, _, _ = cohort
    e = connectivity.unpack(stages.read_edges(spark, cfg.output_root, "fixture_labels", 120), 8).withColumn("same", (F.col("i") < 4) == (F.col("j") < 4))
    r = {x.same: x.r for x in e.groupBy("same").agg(F.avg("r").alias("r")).collect()}
    assert r[True] > r[False] + 0.2
    windows = stages.read_edges(spark, cfg.output_root, "fixture_labels", 30)
    assert windows.select("window_id").distinct().count() == 16
    assert stages.read_edges(spark, cfg.output_root, "fixture_spheres").select(F.size("edges")).distinct().collect()[0][0] == 1


def test_both_edge_layouts_hold_the_same(spark, cohort, tmp_path):
    import dataclasses

    made, cfg, _, _ = cohort
    stored = storage.open_stage(spark, cfg.output_root, "dfc", root=storage.stage_root(cfg.output_root, "dfc", "fixture_labels"))
    assert "edges" not in stored.columns and "Left_Octant_1__Right_Octant_4" in stored.columns
    other = dataclasses.replace(cfg, output_root=str(tmp_path / "o"), windows=dataclasses.replace(cfg.windows, edge_column_threshold=5), atlases=("fixture_labels",))
    stages.extract_stage(spark, other)
    stages.dfc_stage(spark, other)
    packed = storage.open_stage(spark, other.output_root, "dfc")
    assert "edges" in packed.columns
    columns = [r[0] for r in spark.read.option("header", True).csv(storage.labels_path(cfg.output_root, "fixture_labels")).select("column").collect()]
    key = ["run_key", "window_s", "window_id"]
    a = {r[:3]: r.edges for r in stages.read_edges(spark, cfg.output_root, "fixture_labels", columns=columns).select(*key, "edges").collect()}
    b = {r[:3]: r.edges for r in stages.read_edges(spark, other.output_root, "fixture_labels").select(*key, "edges").collect()}
    assert a == b and len(a) == 3 * (16 + 6 + 1)
    with pytest.raises(ValueError, match="missing"):
        stages.read_edges(spark, cfg.output_root, "fixture_labels", columns=[*columns, "Other"])


def test_one_leaf_reads_with_its_keys(spark, cohort):
    _, cfg, act, _ = cohort
    path = next(e.path for e in act if e.sub == "02" and e.atlas == "fixture_labels")
    one = storage.read_shard(spark, path, "activation")
    assert {(r["atlas"], r["cohort"], r["task"], r["sub"], r["leaf"]) for r in one.collect()} == {("fixture_labels", "fixture", "walk", "02", "data")} and one.count() == 120


def test_second_run_skips(spark, cohort):
    _, cfg, _, _ = cohort
    assert {e.status for e in stages.extract_stage(spark, cfg)} == {"skipped"}
    assert {e.status for e in stages.dfc_stage(spark, cfg, [30])} == {"skipped"}


def runs_of(spark, cfg, stage):
    return {r.run_key.rsplit("_", 1)[1]: r["count"] for r in storage.open_stage(spark, cfg.output_root, stage).groupBy("run_key").count().collect()}


def test_later_runs_leave_finished_ones(spark, tmp_path):
    """Runs of one subject that are extracted one after the other, or in different shards, are all there in the end."""
    import dataclasses

    one = lambda made: dataclasses.replace(load_config(made["config"]), atlases=("fixture_labels",))
    made = make_fixture(tmp_path / "f", n_subs=1, n_tr=60, runs=("1",))
    cfg = one(made)
    assert {e.status for e in stages.extract_stage(spark, cfg)} == {"ok"} and {e.status for e in stages.dfc_stage(spark, cfg, [30])} == {"ok"}
    fixture.write_run(made["root"], "01", "2", 60, np.random.default_rng(1), 1)
    assert sorted(e.status for e in stages.extract_stage(spark, cfg)) == ["ok", "skipped"]
    assert sorted(e.status for e in stages.dfc_stage(spark, cfg, [30])) == ["ok", "skipped"]
    assert runs_of(spark, cfg, "activation") == {"run-1": 60, "run-2": 60} and set(runs_of(spark, cfg, "dfc").values()) == {6}

    sharded = make_fixture(tmp_path / "s", n_subs=1, n_tr=60, runs=("1", "2"))
    cfg = one(sharded)
    for k in (0, 1):
        assert {e.status for e in stages.extract_stage(spark, cfg, shard=(k, 2), overwrite=True)} == {"ok"}
    for k in (0, 1):
        assert {e.status for e in stages.dfc_stage(spark, cfg, [30], shard=(k, 2))} == {"ok"}
    assert runs_of(spark, cfg, "activation") == {"run-1": 60, "run-2": 60} and len(runs_of(spark, cfg, "dfc")) == 2


def test_bad_runs_are_set_aside(spark, tmp_path):
    import gzip

    made = make_fixture(tmp_path / "f", n_subs=5, n_tr=60)
    func = lambda s: f"{made['root']}/derivatives/sub-{s}/func/sub-{s}_task-walk"
    open(f"{func('01')}_censor.1D", "w").write("1\n" * 10)
    open(f"{func('02')}_bold.nii.gz", "wb").write(b"no image")
    for s in ("01", "02", "03", "04", "05"):
        open(f"{func(s)}_mask.nii.gz", "wb").write(open(f"{made['root']}/inner_mask.nii.gz", "rb").read())
    open(f"{func('03')}_mask.nii.gz", "wb").write(gzip.compress(nifti.encode(np.ones((2, 2, 2), np.uint8), np.eye(4))))
    people = open(f"{made['root']}/participants.csv").read().replace("walker04,04,fixture,walk,no,,60.0", "walker04,04,fixture,walk,no,,61.0")
    open(f"{made['root']}/participants.csv", "w").write(people)
    import dataclasses

    cfg = load_config(made["config"])
    cfg = dataclasses.replace(cfg, atlases=("fixture_labels",), discovery=dataclasses.replace(cfg.discovery, mask_glob="sub-{sub}_task-{task}_mask.nii.gz"))
    got = {e.sub: (e.status, e.detail) for e in stages.extract_stage(spark, cfg)}
    assert got["05"] == ("ok", "") and [got[s][0] for s in ("01", "02", "03", "04")] == ["error"] * 4
    assert "10 rows for 60" in got["01"][1] and "readable" in got["02"][1] and "mask" in got["03"][1] and "longer" in got["04"][1]
    act = storage.open_stage(spark, cfg.output_root, "activation").orderBy("t").collect()
    _, data = nifti.decode(open(f"{func('05')}_bold.nii.gz", "rb").read())
    inside = fixture.octants() == 1
    inside[[0, -1]] = inside[:, [0, -1]] = inside[:, :, [0, -1]] = False
    assert len(act) == 60 and abs(act[3].v[0] - data[inside][:, 3].mean(dtype=float)) < 1e-3


def test_scans_give_the_stimulus_clock(spark, tmp_path):
    made = make_fixture(tmp_path / "f", n_subs=2, n_tr=60)
    (tmp_path / "scans.csv").write_text("sub,task,run,acq_time_s,n_vols,drop_after_restart\n01,walk,1,0,40,5\n01,walk,2,100,25,5\n")
    import dataclasses

    cfg = dataclasses.replace(load_config(made["config"]), atlases=("fixture_labels",))
    assert {e.status for e in stages.extract_stage(spark, cfg, scans=str(tmp_path / "scans.csv"))} == {"ok"}
    act = storage.open_stage(spark, cfg.output_root, "activation").filter("atlas = 'fixture_labels'")
    got = {(r.sub, r.t): (r.stimulus_time_s, r.run_idx) for r in act.collect()}
    assert got["01", 39] == (39.0, 0) and got["01", 40] == (40.0, 1) and got["01", 59] == (59.0, 1) and got["02", 59] == (59.0, 0)
    (tmp_path / "scans.csv").write_text("sub,task,run,acq_time_s,n_vols\n01,walk,1,0,40\n01,walk,2,100,25\n")
    late = stages.extract_stage(spark, cfg, scans=str(tmp_path / "scans.csv"), overwrite=True)
    assert {(e.sub, e.status) for e in late} == {("01", "error"), ("02", "ok")}


def test_commands(spark, cohort, capsys):
    made, cfg, _, _ = cohort
    assert cli.main(["validate", made["config"]]) == 0
    assert cli.main(["diagnose", made["config"]]) in (0, 2)
    assert storage.exists(spark, f"{storage.meta_root(cfg.output_root, 'fixture')}/coverage.parquet")
    assert cli.main(["extract", made["config"], "--shard", "0/2"]) == 0 and cli.main(["extract", made["config"], "--shard", "1/2"]) == 0
    assert cli.main(["merge-manifests", made["config"], "--stage", "activation"]) == 0
    assert storage.status_counts(storage.read_manifests(spark, f"{storage.meta_root(cfg.output_root, 'fixture')}/manifest_activation.json")).first()[:] == ("skipped", 6)
    with pytest.raises(SystemExit):
        cli.build_parser().parse_args(["extract", "x", "--shard", "3/2"])


def test_discovery_and_readers(spark, cohort, tmp_path):
    made, cfg, _, _ = cohort
    runs = tables.discover(spark, cfg).collect()
    assert [(r.sub, r.task, r.ses) for r in runs] == [("01", "walk", None), ("02", "walk", None), ("03", "walk", None)]
    any_store = nifti.volumes_anywhere(spark, [runs[0].path])
    assert any_store.count() == 120 and any_store.filter("t = 7").first().v == nifti.volumes(spark, [runs[0].path]).filter("t = 7").first().v
    plain = str(tmp_path / "plain.nii")
    open(plain, "wb").write(__import__("gzip").decompress(open(runs[0].path, "rb").read()))
    assert nifti.volumes(spark, [plain], chunk=50).filter("t = 77").first().v == any_store.filter("t = 77").first().v
    (tmp_path / "c.tsv").write_text("a\tb\tc\n1\tn/a\t3\n4\t5\t6\n")
    assert [r.c for r in tables.confounds(spark, str(tmp_path / "c.tsv"), "fmriprep_tsv", 2, ("b", "c")).orderBy("t").collect()] == [[0.0, 3.0], [5.0, 6.0]]
    (tmp_path / "c.1D").write_text("1 2 3\n4 5 6\n")
    assert tables.confounds(spark, str(tmp_path / "c.1D"), "afni_1D", 3).count() == 3
    with pytest.raises(ValueError):
        tables.confounds(spark, str(tmp_path / "c.1D"), "afni_1D", 7)


def test_paths(spark, tmp_path):
    assert storage.stage_root("/o", "dfc", "a b", 30.0, "c") == "/o/dfc/atlas=a-b/window_s=30/cohort=c"
    assert storage.stage_root("/o", "dfc", "a", 2.5) == "/o/dfc/atlas=a/window_s=2.5"
    assert storage.manifest_name("dfc", (3, 20)) == "shards/manifest_dfc_shard-0003-of-0020.json"
    runs = spark.createDataFrame([("k1", "t", "1", "a b"), ("k2", "t", "1", "a-b"), ("k3", "t", "2", "a b")], "run_key string, task string, sub string, ses string")
    assert sorted(r.run_key for r in storage.shared_leaves(runs).collect()) == ["k1", "k2"]
    for text in ("one", "two"):
        storage.write_text(spark, f"{tmp_path}/x/y.txt", text)
        assert open(f"{tmp_path}/x/y.txt").read() == text
    import os

    assert [f for f in os.listdir(f"{tmp_path}/x") if not f.endswith(".crc")] == ["y.txt"]
