"""Every operator as a query over the driver's tables, with the SQL of the same result where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from nodetide.functions import names as N
from nodetide.operators import clean, cohort, connectivity, diagnostics, extract, spatial
from nodetide.plans import grid, timing, views
from nodetide.plans.views import SQL_EVENTS, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _null_nan(c):
    return F.when(F.isnan(c), None).otherwise(c)


_PEARSON = """CASE WHEN count(*) < 2 OR var_pop({x}) = 0 OR var_pop({y}) = 0 THEN NULL ELSE round(greatest(-1.0, least(1.0, covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})))), 6) END"""
_WINDOWS = """SELECT CAST(k AS INTEGER) AS window_id, k * {s} AS s, k * {s} + {w} AS e FROM (SELECT unnest(range(0, {n})) AS k)"""



# ---- clocks and windows --------------------------------------------------------------------------------


def _runs(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("run_key"), (F.col("n_nationkey") + 3).alias("n_tr"), (F.lit(1.0) + F.col("n_regionkey") * 0.25).alias("tr"))


@query("SELECT n_name AS run_key, CAST(t AS INTEGER) AS t, round(t * (1.0 + n_regionkey * 0.25), 4)::DOUBLE AS time_s, round(t * (1.0 + n_regionkey * 0.25), 4)::DOUBLE AS stimulus_time_s, 0 AS run_idx FROM (SELECT *, unnest(range(0, n_nationkey + 3)) AS t FROM nation)")
def time_axis(spark, sf_dir):
    a = timing.build_time_axis(_runs(spark, sf_dir))
    return a.select("run_key", "t", *[F.round(F.col(c).cast("double"), 4).alias(c) for c in ("time_s", "stimulus_time_s")], F.col("run_idx").cast("int").alias("run_idx"))


@query("""WITH seg AS (SELECT n_name AS run_key, i AS seg, CASE WHEN i = 0 THEN 2 ELSE n_nationkey + 1 END AS n_vols, i * 10.0 AS o, CASE WHEN i = 0 THEN 0 ELSE 2 END AS first_t, 1.0 + n_regionkey * 0.25 AS tr FROM nation, (SELECT unnest([0, 1]) AS i))
SELECT run_key, CAST(first_t + k AS INTEGER) AS t, round((first_t + k) * tr, 4)::DOUBLE AS time_s, round(o + k * tr, 4)::DOUBLE AS stimulus_time_s, CAST(seg AS INTEGER) AS run_idx FROM (SELECT *, unnest(range(0, n_vols)) AS k FROM seg)""")
def segments_clock(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    seg = runs.select("run_key", F.explode(F.array(F.lit(0), F.lit(1))).alias("seg_idx"), "n_tr").select("run_key", "seg_idx", F.when(F.col("seg_idx") == 0, 2).otherwise(F.col("n_tr") - 2).alias("n_vols"), (F.col("seg_idx") * 10.0).alias("stimulus_offset_s"))
    a = timing.build_time_axis(runs, seg, "from_scans")
    return a.select("run_key", "t", *[F.round(F.col(c).cast("double"), 4).alias(c) for c in ("time_s", "stimulus_time_s")], F.col("run_idx").cast("int").alias("run_idx"))


@query("""WITH s AS (SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS seg_idx, CAST(o_orderkey % 50 + 5 AS INTEGER) AS n FROM orders),
k AS (SELECT *, CAST(n - CASE WHEN seg_idx > 0 THEN 2 ELSE 0 END AS INTEGER) AS n_vols FROM s)
SELECT CAST(o_custkey AS VARCHAR) AS run_key, seg_idx, n_vols, round(sum(n_vols * 2.0) OVER (PARTITION BY o_custkey ORDER BY seg_idx) - n_vols * 2.0, 4)::DOUBLE AS stimulus_offset_s FROM k""")
def segments_from_scans(spark, sf_dir):
    from pyspark.sql import Window as W

    o = table(spark, sf_dir, "orders").withColumn("seg_idx", (F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).cast("int"))
    scans = o.select(F.col("o_custkey").cast("string").alias("run_key"), "seg_idx", (F.col("seg_idx") * 1000.0).alias("acq_s"), (F.col("o_orderkey") % 50 + 5).cast("int").alias("n_vols"), F.lit(2.0).alias("tr"))
    return timing.segments_from_scans(scans, 2).withColumn("stimulus_offset_s", F.round("stimulus_offset_s", 4))


@query(f"WITH {SQL_EVENTS} SELECT sub, t, bool_and(good_frame) OVER (PARTITION BY sub ORDER BY t ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS good_frame FROM frames")
def censor_dilate(spark, sf_dir):
    axis = views.event_activation(spark, sf_dir).select("run_key", "sub", "t").distinct()
    return timing.censor_mask(axis, views.event_bad_frames(spark, sf_dir), dilate_tr=1).select("sub", "t", "good_frame")


@query("WITH r AS (SELECT n_name, n_nationkey * 7.5 AS d, w FROM nation, (SELECT unnest([30.0, 60.0])::DOUBLE AS w)), n AS (SELECT *, CASE WHEN d <= 0 OR d + 1e-9 < w THEN 0 ELSE CAST(floor((d - w) / (w / 5) + 1e-9) AS INTEGER) + 1 END AS n FROM r) SELECT n_name AS task, w AS window_s, CAST(k AS INTEGER) AS window_id, round(k * w / 5, 6)::DOUBLE AS start_s, round(k * w / 5 + w, 6)::DOUBLE AS end_s FROM (SELECT *, unnest(range(0, n)) AS k FROM n)")
def stimulus_grid(spark, sf_dir):
    return _grid(spark, sf_dir, True)


@query("WITH r AS (SELECT n_name, n_nationkey * 7.5 AS d, w FROM nation, (SELECT unnest([30.0, 60.0])::DOUBLE AS w)), n AS (SELECT *, CASE WHEN d <= 0 THEN 0 ELSE CAST(ceil(d / (w / 5) - 1e-9) AS INTEGER) END AS n FROM r) SELECT n_name AS task, w AS window_s, CAST(k AS INTEGER) AS window_id, round(k * w / 5, 6)::DOUBLE AS start_s, round(k * w / 5 + w, 6)::DOUBLE AS end_s FROM (SELECT *, unnest(range(0, n)) AS k FROM n)")
def grid_incomplete(spark, sf_dir):
    return _grid(spark, sf_dir, False)


def _grid(spark, sf_dir, drop):
    spans = table(spark, sf_dir, "nation").select(F.col("n_name").alias("task"), (F.col("n_nationkey") * 7.5).alias("duration_s"), F.explode(F.array(F.lit(30.0), F.lit(60.0))).alias("window_s"))
    return grid.stimulus_grid(spans, 5, drop).select("task", "window_s", "window_id", *[F.round(c, 6).alias(c) for c in ("start_s", "end_s")])


@query("WITH r AS (SELECT s_name, CAST(s_suppkey % 90 + 10 AS INTEGER) AS n, CAST(s_suppkey % 7 + 5 AS INTEGER) AS w FROM supplier), q AS (SELECT *, greatest(1, w // 5) AS st FROM r) SELECT s_name AS run_key, CAST(s // st AS INTEGER) AS window_id, CAST(s AS INTEGER) AS start_tr, CAST(least(n, s + w) AS INTEGER) AS end_tr FROM (SELECT *, unnest(range(0, n - w + 1, st)) AS s FROM q)")
def index_windows(spark, sf_dir):
    runs = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("run_key"), (F.col("s_suppkey") % 90 + 10).cast("int").alias("n_tr"), (F.col("s_suppkey") % 7 + 5).cast("int").alias("window_tr"))
    return grid.index_windows(runs, 5).select("run_key", "window_id", "start_tr", "end_tr")


@query("SELECT w AS window_s, tr, CAST(floor(w / tr + 0.5) AS INTEGER) AS n_tr_nominal FROM (SELECT unnest([30.0, 60.0, 120.0, 300.0])::DOUBLE AS w), (SELECT unnest([1.0, 1.49, 2.0, 2.47])::DOUBLE AS tr)")
def nominal_tr(spark, sf_dir):
    d = spark.range(1).select(F.explode(F.array(*map(F.lit, (30.0, 60.0, 120.0, 300.0)))).alias("window_s")).select("window_s", F.explode(F.array(*map(F.lit, (1.0, 1.49, 2.0, 2.47)))).alias("tr"))
    return d.withColumn("n_tr_nominal", grid.nominal_frames(F.col("window_s"), F.col("tr")))


@query(f"WITH {SQL_EVENTS}, w AS ({_WINDOWS.format(s=6.0, w=30.0, n=116)}) SELECT window_id, count(*) AS n_frames, CAST(min(t) AS INTEGER) AS first_t, CAST(max(t) AS INTEGER) AS last_t FROM (SELECT DISTINCT sub, t FROM act) a JOIN w ON t >= s - 1e-9 AND t < e - 1e-9 GROUP BY window_id")
def window_membership(spark, sf_dir):
    f = views.event_activation(spark, sf_dir).select("run_key", "t").distinct().withColumns({"stimulus_time_s": F.col("t").cast("float"), "duration_s": F.lit(720.0), "window_s": F.lit(30.0)})
    return grid.assign_windows(f).groupBy("window_id").agg(F.count("*").alias("n_frames"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


@query("SELECT event_id, CAST(unnest(range(greatest(0, CAST(floor((x - 30) / 6 + 1e-9) AS BIGINT) + 1), CAST(floor(x / 6 + 1e-9) AS BIGINT) + 1)) AS INTEGER) AS window_id FROM (SELECT event_id, value AS x FROM events) WHERE x >= 0")
def assign_window_ids(spark, sf_dir):
    e = table(spark, sf_dir, "events").filter("value >= 0")
    return e.select("event_id", F.explode(grid.window_ids(F.col("value"), F.lit(30.0), 5)).alias("window_id"))


@query(f"WITH {SQL_EVENTS} SELECT sub, t FROM (SELECT DISTINCT sub, t FROM act) WHERE t < round_even((CAST(sub AS INTEGER) * 101 + 1) / 2.0, 0)")
def trim(spark, sf_dir):
    f = views.event_activation(spark, sf_dir).select("run_key", "sub", "t").distinct()
    f = f.withColumns({"tr": F.lit(2.0), "n_tr": F.lit(720), "trim_end_s": (F.col("sub").cast("int") * 101 + 1).cast("double")})
    return timing.trim(f).select("sub", "t")


# ---- from voxels to nodes ------------------------------------------------------------------------------


def _voxels(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    return line.select(F.lit("r").alias("run_key"), F.datediff(F.col("l_shipdate"), F.lit("1995-01-01")).alias("t"), F.col("l_partkey").alias("vox_id"), F.col("l_extendedprice").alias("v"))


def _membership(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select(F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int").alias("node_idx"), F.col("p_partkey").alias("vox_id"))


_VOX = "vox AS (SELECT date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS t, l_partkey AS vox_id, l_extendedprice AS v FROM lineitem), mem AS (SELECT CAST(regexp_extract(p_brand, '[0-9]+$') AS INTEGER) AS node_idx, p_partkey AS vox_id FROM part)"


@query(f"WITH {_VOX} SELECT CAST(t AS INTEGER) AS t, node_idx, round(avg(v), 6) AS x, count(*) AS n_voxels FROM vox JOIN mem USING (vox_id) GROUP BY t, node_idx")
def parcel_mean(spark, sf_dir):
    return extract.node_means_long(_voxels(spark, sf_dir), _membership(spark, sf_dir)).select("t", "node_idx", F.round("x", 6).alias("x"), "n_voxels")


@query(f"WITH {_VOX}, twice AS (SELECT * FROM mem UNION ALL SELECT * FROM mem WHERE vox_id % 3 = 0) SELECT CAST(t AS INTEGER) AS t, node_idx, round(avg(v), 6) AS x, count(*) AS n_voxels FROM vox JOIN twice USING (vox_id) GROUP BY t, node_idx")
def parcel_mean_weighted(spark, sf_dir):
    m = _membership(spark, sf_dir)
    return extract.node_means_long(_voxels(spark, sf_dir), m.unionAll(m.filter("vox_id % 3 = 0"))).select("t", "node_idx", F.round("x", 6).alias("x"), "n_voxels")


@query(f"WITH {_VOX} SELECT CAST(t AS INTEGER) AS t, node_idx, round(avg(v), 6) AS x FROM vox JOIN mem USING (vox_id) WHERE vox_id % 2 = 0 GROUP BY t, node_idx")
def mask_restriction(spark, sf_dir):
    mask = table(spark, sf_dir, "part").filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("vox_id"))
    return extract.node_means_long(extract.in_mask(_voxels(spark, sf_dir), mask), _membership(spark, sf_dir)).select("t", "node_idx", F.round("x", 6).alias("x"))


@query(f"WITH {_VOX}, m AS (SELECT CAST(t AS INTEGER) AS t, node_idx, avg(v) AS x FROM vox JOIN mem USING (vox_id) GROUP BY t, node_idx) SELECT g.t, CAST(n AS INTEGER) AS node_idx, round(m.x::FLOAT::DOUBLE, 2) AS x FROM (SELECT DISTINCT CAST(t AS INTEGER) AS t FROM vox) g CROSS JOIN (SELECT unnest(range(0, 60)) AS n) LEFT JOIN m ON m.t = g.t AND m.node_idx = n")
def empty_parcel(spark, sf_dir):
    v = _voxels(spark, sf_dir)
    long = extract.to_long(extract.node_means(v, _membership(spark, sf_dir), 60))
    return long.select("t", "node_idx", F.round(_null_nan(F.col("x").cast("double")), 2).alias("x"))


@query("WITH p AS (SELECT label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings), s AS (SELECT label, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM p GROUP BY label) SELECT CAST(s.label AS INTEGER) AS node_idx, count(*) AS n_points FROM p JOIN s ON (p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y) + (p.z - s.z) * (p.z - s.z) <= 0.15 * 0.15 GROUP BY s.label")
def sphere_membership(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("label", F.col("vec_id").alias("vox_id"), *[F.col("embedding")[i].cast("double").alias(a) for i, a in enumerate("xyz")])
    seeds = e.groupBy(F.col("label").cast("int").alias("node_idx")).agg(*[F.avg(a).alias(f"s{a}") for a in "xyz"]).withColumn("seed_idx", F.col("node_idx"))
    return spatial.sphere_membership(e, seeds, 0.15).groupBy("node_idx").agg(F.count("*").alias("n_points"))


@query("WITH g AS (SELECT label, avg(vec_id % 10) AS i, avg(vec_id // 10 % 10) AS j, avg(vec_id // 100) AS k FROM embeddings GROUP BY label), n AS (SELECT CAST(unnest(range(0, 12)) AS INTEGER) AS idx) SELECT idx AS \"index\", round(2 * i - 8, 6) AS x, round(2 * j - 8, 6) AS y, round(2 * k - 6, 6) AS z FROM n LEFT JOIN g ON g.label = n.idx")
def label_centroids(spark, sf_dir):
    image = table(spark, sf_dir, "embeddings").select("label", (F.col("vec_id") % 10).alias("i"), (F.floor(F.col("vec_id") / 10) % 10).alias("j"), F.floor(F.col("vec_id") / 100).alias("k"))
    nodes = spark.range(12).select(F.col("id").cast("int").alias("index"))
    out = spatial.label_centroids(image, nodes, [[2, 0, 0, -8], [0, 2, 0, -8], [0, 0, 2, -6]])
    return out.select("index", *[F.round(_null_nan(F.col(a)), 6).alias(a) for a in "xyz"])


@query("WITH c AS (SELECT 'cort' AS part, n_nationkey AS old_id, CAST(n_nationkey AS INTEGER) AS new_id, n_name AS name FROM nation WHERE n_nationkey > 0), s AS (SELECT 'sub' AS part, r_regionkey AS old_id, CAST(row_number() OVER (ORDER BY r_regionkey) + 24 AS INTEGER) AS new_id, r_name AS name FROM region WHERE r_regionkey > 0 AND r_name <> 'ASIA') SELECT * FROM c UNION ALL SELECT * FROM s")
def label_merge_plan(spark, sf_dir):
    cort = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.when(F.col("n_nationkey") == 0, "Background").otherwise(F.col("n_name")).alias("name"))
    sub = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    return spatial.merge_plan(cort, sub, (*spatial.NUISANCE, "ASIA"))


@query("SELECT n_regionkey AS network, round(avg(n_nationkey), 6)::DOUBLE AS x, CAST(count(*) AS INTEGER) AS n_seeds, min_by(n_name, n_nationkey) AS full_name, CAST(row_number() OVER (ORDER BY min(n_nationkey)) AS INTEGER) AS \"index\" FROM nation GROUP BY n_regionkey")
def network_nodes(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    seeds = n.select(F.col("n_nationkey").alias("ord"), F.col("n_regionkey").alias("network"), F.col("n_nationkey").cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"), F.col("n_name").alias("name"))
    return spatial.network_nodes(seeds).select("network", F.round("x", 6).alias("x"), "n_seeds", "full_name", "index")


# ---- names ---------------------------------------------------------------------------------------------


@query("WITH s AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Left ' || p_name WHEN 1 THEN p_name || ' r' WHEN 2 THEN ' ' || p_name || ' (a/b), ''c''_right' ELSE p_name END AS s FROM part) SELECT p_partkey, translate(trim(s), ' /,''()', '_-') AS clean, CASE WHEN lower(s) LIKE 'left%' OR lower(s) LIKE '% l' OR contains(lower(s), '_left') THEN 'L' WHEN lower(s) LIKE 'right%' OR lower(s) LIKE '% r' OR contains(lower(s), '_right') THEN 'R' ELSE 'B' END AS hemi, regexp_replace(s, '^(Left|Right)[\\s_]+', '') AS stem FROM s")
def clean_name_hemi(spark, sf_dir):
    name, k = F.col("p_name"), F.col("p_partkey") % 4
    s = F.when(k == 0, F.concat(F.lit("Left "), name)).when(k == 1, F.concat(name, F.lit(" r"))).when(k == 2, F.concat(F.lit(" "), name, F.lit(" (a/b), 'c'_right"))).otherwise(name)
    return table(spark, sf_dir, "part").select("p_partkey", N.clean_name(s).alias("clean"), N.hemisphere(s).alias("hemi"), N.hemisphere_stem(s).alias("stem"))


@query("WITH o AS (SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN '' ELSE 's ' || o_orderstatus END AS ses, CASE WHEN o_orderkey % 2 = 0 THEN '1/2' END AS run FROM orders) SELECT o_orderkey, 'cohort-c_sub-' || o_custkey || '_task-' || o_orderpriority || CASE WHEN coalesce(ses, '') <> '' THEN '_ses-' || ses ELSE '' END || CASE WHEN run IS NOT NULL THEN '_run-' || run ELSE '' END AS run_key, CASE WHEN coalesce(ses, '') = '' AND run IS NULL THEN 'data' ELSE concat_ws('_', CASE WHEN coalesce(ses, '') <> '' THEN 'ses-' || translate(ses, '/\\= ', '----') END, CASE WHEN run IS NOT NULL THEN 'run-' || translate(run, '/\\= ', '----') END) END || '.parquet' AS leaf FROM o")
def run_key_leaf(spark, sf_dir):
    k, none = F.col("o_orderkey"), F.lit(None).cast("string")
    ses = F.when(k % 3 == 0, none).when(k % 3 == 1, "").otherwise(F.concat(F.lit("s "), F.col("o_orderstatus")))
    run = F.when(k % 2 == 0, "1/2")
    return table(spark, sf_dir, "orders").select("o_orderkey", N.run_key(F.lit("c"), F.col("o_custkey").cast("string"), F.col("o_orderpriority"), ses, run, none).alias("run_key"), N.leaf_name(ses, run, none).alias("leaf"))


@query("SELECT a.n_name || '__' || b.n_name AS edge, CAST(a.n_nationkey * (2 * 25 - a.n_nationkey - 1) // 2 + b.n_nationkey - a.n_nationkey - 1 AS INTEGER) AS e, CAST(300 AS BIGINT) AS n_edges FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey")
def edge_names(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    packed = n.agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("all"))
    pairs = packed.select("all", F.explode("all").alias("a")).select("a", F.explode(F.filter("all", lambda b: b["n_nationkey"] > F.col("a.n_nationkey"))).alias("b"))
    return pairs.select(N.edge_name(F.col("a.n_name"), F.col("b.n_name")).alias("edge"), N.edge_index(F.col("a.n_nationkey"), F.col("b.n_nationkey"), 25).alias("e"), N.n_edges(F.lit(25)).alias("n_edges"))


@query("SELECT o_orderkey, o_orderstatus AS task, '0' || o_custkey AS sub FROM orders")
def hive_keys(spark, sf_dir):
    path = F.concat(F.lit("/x/atlas=a/task="), F.col("o_orderstatus"), F.lit("/sub=9/sub=0"), F.col("o_custkey").cast("string"), F.lit("/data.parquet"))
    keys = N.hive_keys(path)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.element_at(keys, "task").alias("task"), F.element_at(keys, "sub").alias("sub"))


# ---- connectivity --------------------------------------------------------------------------------------


def _windowed(spark, sf_dir, widths=(30.0,), good_only=True):
    a = views.event_activation(spark, sf_dir)
    bad = views.event_bad_frames(spark, sf_dir)
    if good_only:
        d = a.join(bad, ["run_key", "t"], "left_anti")
    else:
        d = a.join(bad.withColumn("_bad", F.lit(True)), ["run_key", "t"], "left").withColumn("good_frame", F.col("_bad").isNull()).drop("_bad")
    d = d.withColumns({"duration_s": F.lit(720.0), "window_s": F.explode(F.array(*map(F.lit, widths))), "stimulus_time_s": F.col("t").cast("float")})
    return grid.assign_windows(d)


def _pairs_sql(widths, good="good_frame", value="x", extra=""):
    w = " UNION ALL ".join(f"SELECT {x}::DOUBLE AS window_s, * FROM ({_WINDOWS.format(s=x / 5, w=x, n=int((720 - x) / (x / 5) + 1e-9) + 1)})" for x in widths)
    return f"""WITH {SQL_EVENTS}, w AS ({w}),
j AS (SELECT w.window_s, w.window_id, a.sub, a.t, a.node, {value} AS x FROM act a JOIN frames f ON a.t = f.t AND a.sub = f.sub JOIN w ON a.t >= w.s - 1e-9 AND a.t < w.e - 1e-9 WHERE {good}),
r AS (SELECT l.sub, l.window_s, l.window_id, l.node AS i, r.node AS j, count(*) AS n, {_PEARSON.format(x='l.x', y='r.x')} AS r FROM j l JOIN j r ON l.sub = r.sub AND l.window_s = r.window_s AND l.window_id = r.window_id AND l.t = r.t AND l.node < r.node GROUP BY ALL)
{extra or 'SELECT sub, window_id, i, j, n, r FROM r'}"""


@query(_pairs_sql((30.0,)))
def dfc_pearson_long(spark, sf_dir):
    r = connectivity.pearson_long(_windowed(spark, sf_dir), ["sub", "window_id"])
    return r.withColumn("r", F.round(_null_nan(F.col("r")), 6))


@query(_pairs_sql((30.0, 60.0, 120.0, 300.0), extra="SELECT sub, window_s, window_id, i, j, n, r FROM r"))
def dfc_window_sweep(spark, sf_dir):
    r = connectivity.pearson_long(_windowed(spark, sf_dir, (30.0, 60.0, 120.0, 300.0)), ["sub", "window_s", "window_id"])
    return r.withColumn("r", F.round(_null_nan(F.col("r")), 6))


@query(f"""WITH {SQL_EVENTS}, w AS ({_WINDOWS.format(s=6.0, w=30.0, n=116)}), j AS (SELECT w.window_id, f.* FROM frames f JOIN w ON f.t >= w.s - 1e-9 AND f.t < w.e - 1e-9)
SELECT sub, window_id, CAST(count(*) AS INTEGER) AS n_tr_available, CAST(count(*) FILTER (good_frame) AS INTEGER) AS n_tr_effective, round(count(*) FILTER (good_frame) / count(*), 5)::DOUBLE AS frac_good_frames, CAST(min(t) FILTER (good_frame) AS INTEGER) AS start_tr, min(t // 240) <> max(t // 240) AS crosses_run_boundary, false AS crosses_clip_boundary, count(*) FILTER (good_frame) - 1 < 5 AS rank_deficient FROM j GROUP BY sub, window_id HAVING count(*) FILTER (good_frame) >= 2""")
def dfc_qc(spark, sf_dir):
    f = connectivity.with_defaults(views.event_frames(spark, sf_dir)).withColumns({"duration_s": F.lit(720.0), "window_s": F.lit(30.0), "n_nodes": F.size("v")})
    q = connectivity.quality(grid.assign_windows(f), ["sub", "window_id"], F.col("n_nodes"))
    return q.select("sub", "window_id", F.col("n_tr_available").cast("int").alias("n_tr_available"), F.col("n_tr_effective").cast("int").alias("n_tr_effective"), F.round(F.col("frac_good_frames").cast("double"), 5).alias("frac_good_frames"), "start_tr", "crosses_run_boundary", "crosses_clip_boundary", "rank_deficient")


@query(_pairs_sql((30.0, 120.0), value="x::FLOAT::DOUBLE", extra="SELECT sub, window_s, window_id, i, j, r FROM r"))
def dfc_packed(spark, sf_dir):
    spans = spark.createDataFrame([("events", w, 720.0, int(w)) for w in (30.0, 120.0)], "task string, window_s double, duration_s double, n_tr_nominal int")
    out = connectivity.dfc(views.event_frames(spark, sf_dir), spans, double=True)
    return connectivity.unpack(out, 5).select("sub", "window_s", "window_id", "i", "j", F.round(_null_nan(F.col("r")), 6).alias("r"))


@query(f"WITH e AS (SELECT CAST(label % 2 AS VARCHAR) AS sub, vec_id, CAST(unnest(range(0, 64)) AS INTEGER) AS node, unnest(embedding)::DOUBLE AS x FROM embeddings) SELECT l.sub, l.node AS i, r.node AS j, {_PEARSON.format(x='l.x', y='r.x')} AS r FROM e l JOIN e r ON l.sub = r.sub AND l.vec_id = r.vec_id AND l.node < r.node GROUP BY ALL")
def dfc_packed_emb(spark, sf_dir):
    edges = connectivity.pearson_packed(views.embedding_frames(spark, sf_dir), ["sub"], double=True)
    return connectivity.unpack(edges, 64).select("sub", "i", "j", F.round(_null_nan(F.col("r")), 6).alias("r"))


@query(_pairs_sql((120.0,), extra="SELECT sub, window_id, i, j, r FROM r UNION ALL SELECT sub, window_id, j, i, r FROM r UNION ALL SELECT sub, window_id, n, n, 1.0 FROM (SELECT DISTINCT sub, window_id FROM r), (SELECT CAST(unnest(range(0, 5)) AS INTEGER) AS n)"))
def full_matrix(spark, sf_dir):
    r = connectivity.pearson_long(_windowed(spark, sf_dir, (120.0,)), ["sub", "window_id"])
    nodes = spark.range(5).select(F.col("id").cast("int").alias("node_idx"))
    return connectivity.full_matrix(r, ["sub", "window_id"], nodes).withColumn("r", F.round(_null_nan(F.col("r")), 6))


@query(_pairs_sql((120.0,), extra="SELECT sub, window_id, i, j, CASE WHEN abs(r) < 1 THEN round(atanh(r), 4) END AS z FROM r"))
def fisher_z(spark, sf_dir):
    r = connectivity.pearson_long(_windowed(spark, sf_dir, (120.0,)), ["sub", "window_id"]).withColumn("r", F.round(_null_nan(F.col("r")), 6))
    return r.select("sub", "window_id", "i", "j", F.when(F.abs("r") < 1, F.round(N.fisher_z(F.col("r")), 4)).alias("z"))


@query(_pairs_sql((120.0,), good="true", value="CASE WHEN f.good_frame THEN x ELSE 0.0 END"))
def zero_fill_bias(spark, sf_dir):
    d = _windowed(spark, sf_dir, (120.0,), good_only=False).withColumn("x", F.when(F.col("good_frame"), F.col("x")).otherwise(0.0))
    return connectivity.pearson_long(d, ["sub", "window_id"]).withColumn("r", F.round(_null_nan(F.col("r")), 6))


@query("""WITH e AS (SELECT CAST(label % 2 AS VARCHAR) AS sub, vec_id, CAST(unnest(range(0, 64)) AS INTEGER) AS node, unnest(embedding)::DOUBLE AS x FROM embeddings),
r AS (SELECT l.sub, l.node AS i, r.node AS j, corr(l.x, r.x) AS a, (avg(l.x * r.x) - avg(l.x) * avg(r.x)) / (stddev_pop(l.x) * stddev_pop(r.x)) AS b FROM e l JOIN e r ON l.sub = r.sub AND l.vec_id = r.vec_id AND l.node < r.node GROUP BY ALL)
SELECT sub, CASE WHEN max(abs(a - b)) < 1e-6 THEN 0.0 ELSE max(abs(a - b)) END::DOUBLE AS max_abs_diff, max(abs(a - b)) < 1e-6 AS same FROM r GROUP BY sub""")
def equivalence_check(spark, sf_dir):
    f = views.embedding_frames(spark, sf_dir)
    packed = connectivity.unpack(connectivity.pearson_packed(f, ["sub"]), 64)
    # Two routes to the same edges: matrices in packed form, and built-in aggregates; an edge that only one of them has differs without bound.
    long = connectivity.pearson_long(f.select("sub", "t", F.posexplode("v").alias("node_idx", "x")), ["sub"]).select("sub", "i", "j", "r")
    diff = connectivity.max_abs_difference(packed, long, ["sub", "i", "j"], "r").withColumnRenamed("max_abs_diff", "d")
    return diff.select("sub", F.when(F.col("d") < 1e-6, 0.0).otherwise(F.col("d")).alias("max_abs_diff"), (F.col("d") < 1e-6).alias("same"))


# ---- diagnostics ---------------------------------------------------------------------------------------


@query(f"WITH {SQL_EVENTS} SELECT 'events' AS movie, t::DOUBLE AS stimulus_time_s, count(*) FILTER (good_frame) AS n_good, count(*) AS n_total FROM frames GROUP BY t")
def coverage(spark, sf_dir):
    return diagnostics.coverage(views.event_frames(spark, sf_dir)).withColumn("stimulus_time_s", F.col("stimulus_time_s").cast("double"))


@query(f"WITH {SQL_EVENTS}, p AS (SELECT a.sub, a.t, a.x, b.x AS y FROM act a JOIN act b ON a.sub = b.sub AND a.t = b.t AND a.node = 0 AND b.node = 1 JOIN frames f ON f.sub = a.sub AND f.t = a.t WHERE f.good_frame), r AS (SELECT sub, corr(x::FLOAT::DOUBLE, y::FLOAT::DOUBLE) AS r FROM p GROUP BY sub) SELECT 'Area' AS region, count(*) AS n_subjects, round(avg(r), 6) AS mean_lr_r, avg(r) >= 0.95 AS merge_candidate FROM r")
def lr_diagnostic(spark, sf_dir):
    nodes = spark.createDataFrame([(0, "Left Area", "L", "Left_Area"), (1, "Right_Area", "R", "Right_Area"), (2, "Middle", "B", "Middle")], "node_idx int, name string, hemi string, column string")
    out = diagnostics.left_right(views.event_frames(spark, sf_dir), nodes)
    return out.select("region", "n_subjects", F.round(_null_nan(F.col("mean_lr_r")), 6).alias("mean_lr_r"), "merge_candidate")


_ISC = f"""WITH {SQL_EVENTS}, s AS (SELECT sub, t, x FROM act WHERE node = 0), z AS (SELECT sub, t, (x - avg(x) OVER (PARTITION BY sub)) / stddev_pop(x) OVER (PARTITION BY sub) AS z FROM s),
l AS (SELECT sub, t, z, (sum(z) OVER (PARTITION BY t) - z) / 3 AS loo FROM z), lags AS (SELECT unnest(range(-30, 31)) AS lag),
c AS (SELECT a.sub, lag, corr(a.z, b.loo) AS r FROM l a CROSS JOIN lags JOIN l b ON a.sub = b.sub AND b.t = a.t + lag GROUP BY ALL), best AS (SELECT sub, CAST(arg_max(lag, (r, -lag)) AS INTEGER) AS best_lag_tr, round(max(r), 6) AS peak_isc FROM c GROUP BY sub)"""


def _isc(spark, sf_dir):
    s = views.event_activation(spark, sf_dir).filter("node_idx = 0").select("run_key", "sub", "task", "t", "x")
    return diagnostics.isc_alignment(s)


@query(_ISC + " SELECT sub, 'events' AS movie, best_lag_tr, peak_isc FROM best")
def isc_alignment(spark, sf_dir):
    return _isc(spark, sf_dir).withColumn("peak_isc", F.round("peak_isc", 6))


@query(_ISC + " SELECT median(abs(best_lag_tr))::DOUBLE AS median_abs_lag, count(*) AS n, CASE WHEN median(abs(best_lag_tr)) <= 1 THEN 'passed' ELSE 'failed' END AS status FROM best")
def isc_gate(spark, sf_dir):
    return diagnostics.isc_gate(_isc(spark, sf_dir))


# ---- cohort --------------------------------------------------------------------------------------------


def _participants(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_name").alias("participant_id"), F.col("c_custkey").cast("string").alias("sub"), F.lit("c").alias("cohort"), F.when(F.col("c_nationkey") % 2 == 0, "O").otherwise("F").alias("task"), (F.col("c_custkey") % 7 == 0).alias("excluded"), F.when(F.col("c_custkey") % 14 == 0, "motion").alias("exclusion_reason"), F.col("c_acctbal").alias("end_movie"))


def _disk(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("sub"), F.col("o_orderstatus").alias("task"), F.col("o_orderkey").alias("bold"))


_PART = "p AS (SELECT c_name AS participant_id, CAST(c_custkey AS VARCHAR) AS sub, CASE WHEN c_nationkey % 2 = 0 THEN 'O' ELSE 'F' END AS task, c_custkey % 7 = 0 AS excluded, CASE WHEN c_custkey % 14 = 0 THEN 'motion' END AS exclusion_reason, c_acctbal AS end_movie FROM customer), runs AS (SELECT CAST(o_custkey AS VARCHAR) AS sub, o_orderstatus AS task, o_orderkey AS bold FROM orders)"


@query(f"WITH {_PART} SELECT runs.sub, runs.task, bold, participant_id, round(end_movie, 2) AS trim_end_s FROM runs JOIN p ON p.sub = runs.sub AND p.task = runs.task AND NOT excluded")
def participants_join(spark, sf_dir):
    return cohort.attach_participants(_disk(spark, sf_dir), _participants(spark, sf_dir), "end_movie", "seconds").select("sub", "task", "bold", "participant_id", F.round("trim_end_s", 2).alias("trim_end_s"))


@query(f"WITH {_PART} SELECT DISTINCT sub, task FROM runs r WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.sub = r.sub AND p.task = r.task)")
def only_disk(spark, sf_dir):
    return cohort.only_on_disk(_disk(spark, sf_dir), _participants(spark, sf_dir))


@query(f"WITH {_PART} SELECT DISTINCT sub, task FROM p WHERE NOT excluded AND NOT EXISTS (SELECT 1 FROM runs r WHERE p.sub = r.sub AND p.task = r.task)")
def only_table(spark, sf_dir):
    return cohort.only_in_table(_disk(spark, sf_dir), _participants(spark, sf_dir))


@query(f"WITH {_PART} SELECT sub, task, count(*) AS n_rows FROM runs GROUP BY ALL HAVING count(*) > 1")
def dup_keys(spark, sf_dir):
    return cohort.duplicate_keys(_disk(spark, sf_dir))


@query(f"WITH {_PART} SELECT participant_id, sub, task FROM p WHERE excluded AND exclusion_reason IS NULL")
def missing_reason(spark, sf_dir):
    return cohort.without_reason(_participants(spark, sf_dir)).select("participant_id", "sub", "task")


@query(f"WITH {_PART} SELECT sub, end_movie FROM p WHERE abs(end_movie / 2.0 - round_even(end_movie / 2.0, 0)) > 1e-6")
def whole_tr_check(spark, sf_dir):
    return cohort.partial_trims(_participants(spark, sf_dir), "end_movie", 2.0).select("sub", "end_movie")


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS r FROM orders) WHERE r % 8 = 3")
def shard_round_robin(spark, sf_dir):
    return cohort.shard(table(spark, sf_dir, "orders").select("o_orderkey"), 3, 8, ["o_orderkey"])


@query("SELECT CASE o_orderstatus WHEN 'O' THEN 'ok' WHEN 'F' THEN 'skipped' ELSE 'error' END AS status, count(*) AS n FROM orders GROUP BY 1")
def manifest_counts(spark, sf_dir):
    from nodetide.sources.storage import status_counts

    s = F.col("o_orderstatus")
    return status_counts(table(spark, sf_dir, "orders").select(F.when(s == "O", "ok").when(s == "F", "skipped").otherwise("error").alias("status")))


@query("SELECT CAST(o_custkey AS VARCHAR) AS sub, o_orderstatus AS task FROM orders EXCEPT SELECT CAST(c_custkey AS VARCHAR), 'O' FROM customer")
def key_difference(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("sub"), F.lit("O").alias("task"))
    return _disk(spark, sf_dir).select("sub", "task").subtract(c)


@query("SELECT CAST(o_custkey AS VARCHAR) AS sub, o_orderstatus AS task FROM orders INTERSECT SELECT CAST(c_custkey AS VARCHAR), 'O' FROM customer")
def key_intersection(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("sub"), F.lit("O").alias("task"))
    return _disk(spark, sf_dir).select("sub", "task").intersect(c)


@query("SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'a' ELSE 'b' END AS cohort, CAST(30 + 30 * (o_orderkey % 2) AS VARCHAR) AS window_s, count(*) AS n FROM orders WHERE o_orderkey % 2 = 0 GROUP BY ALL")
def pooled_read(spark, sf_dir):
    """Partition keys as text and a predicate on them, over a table of that layout."""
    from nodetide.sources.storage import with_path_keys

    o = table(spark, sf_dir, "orders").withColumns({"atlas": F.lit("x y"), "window_s": (F.lit(30) + 30 * (F.col("o_orderkey") % 2)).cast("double"), "cohort": F.when(F.col("o_orderkey") % 2 == 0, "a").otherwise("b"), "task": F.lit("t"), "sub": F.col("o_custkey")})
    return with_path_keys(o, "dfc").filter("cohort = 'a'").groupBy("cohort", "window_s").agg(F.count("*").alias("n"))


# ---- cleaning ------------------------------------------------------------------------------------------


@query(f"WITH {SQL_EVENTS} SELECT sub, node, t, round(x - (regr_intercept(x, t) OVER w + regr_slope(x, t) OVER w * t), 4) AS x FROM act WINDOW w AS (PARTITION BY sub, node)")
def detrend(spark, sf_dir):
    d = clean.detrend(views.event_activation(spark, sf_dir), ["sub", "node_idx"])
    return d.select("sub", F.col("node_idx").alias("node"), "t", F.round("x", 4).alias("x"))


@query(f"WITH {SQL_EVENTS} SELECT sub, node, t, round((x - avg(x) OVER w) / stddev_samp(x) OVER w, 4) AS x FROM act WINDOW w AS (PARTITION BY sub, node)")
def zscore_sample(spark, sf_dir):
    d = clean.standardize(views.event_activation(spark, sf_dir), ["sub", "node_idx"])
    return d.select("sub", F.col("node_idx").alias("node"), "t", F.round("x", 4).alias("x"))


@query(f"WITH {SQL_EVENTS}, j AS (SELECT a.*, c.x AS c FROM act a JOIN act c ON a.sub = c.sub AND a.t = c.t AND c.node = 0 WHERE a.node > 0) SELECT sub, node, t, round(x - (avg(x) OVER w + regr_slope(x, c) OVER w * (c - avg(c) OVER w)), 4) AS x FROM j WINDOW w AS (PARTITION BY sub, node)")
def confound_residual(spark, sf_dir):
    a = views.event_activation(spark, sf_dir)
    c = a.filter("node_idx = 0").select("sub", "t", F.col("x").alias("c"))
    d = clean.residual(a.filter("node_idx > 0").join(c, ["sub", "t"]), ["sub", "node_idx"], "c")
    return d.select("sub", F.col("node_idx").alias("node"), "t", F.round("x", 4).alias("x"))


@query(f"""WITH {SQL_EVENTS}, d AS (SELECT sub, node, t, CAST(x AS FLOAT)::DOUBLE AS y, t::DOUBLE AS c1, sin(t / 24.0) AS c2, cos(t / 24.0) AS c3 FROM act),
m AS (SELECT sub, node, t, y, y - avg(y) OVER w AS z, c1 - avg(c1) OVER w AS p, c2 - avg(c2) OVER w AS c2, c3 - avg(c3) OVER w AS c3 FROM d WINDOW w AS (PARTITION BY sub, node)),
q AS (SELECT *, c2 - p * (sum(p * c2) OVER w / sum(p * p) OVER w) AS q, c3 - p * (sum(p * c3) OVER w / sum(p * p) OVER w) AS c3b FROM m WINDOW w AS (PARTITION BY sub, node)),
r AS (SELECT *, c3b - q * (sum(q * c3b) OVER w / sum(q * q) OVER w) AS r FROM q WINDOW w AS (PARTITION BY sub, node))
SELECT sub, node AS node_idx, t, round(CAST(y - p * (sum(p * z) OVER w / sum(p * p) OVER w) - q * (sum(q * z) OVER w / sum(q * q) OVER w) - r * (sum(r * z) OVER w / sum(r * r) OVER w) AS FLOAT)::DOUBLE, 3) AS x
FROM r WINDOW w AS (PARTITION BY sub, node)""")
def confound_residual_multi(spark, sf_dir):
    f = views.event_frames(spark, sf_dir)
    c = f.select("run_key", "t", F.array(F.col("t").cast("double"), F.sin(F.col("t") / 24.0), F.cos(F.col("t") / 24.0)).alias("c"))
    return extract.to_long(clean.clean_runs(f, 1.0, c)).select("sub", "node_idx", "t", F.round(F.col("x").cast("double"), 3).alias("x"))


@query()
def bandpass(spark, sf_dir):
    return extract.to_long(clean.clean_runs(views.event_frames(spark, sf_dir), 1.0, low=0.01, high=0.1)).select("sub", "node_idx", "t", F.round(F.col("x").cast("double"), 4).alias("x"))


# ---- readers, layouts and atlases ----------------------------------------------------------------------


@query(f"WITH {SQL_EVENTS} SELECT sub, max(t) + 1.5 AS duration_s FROM frames GROUP BY sub")
def observed_duration(spark, sf_dir):
    a = views.event_frames(spark, sf_dir)
    return connectivity.observed_durations(a, 1.5).select(F.col("run_key").alias("sub"), "duration_s")


@query("SELECT CAST(o_custkey AS VARCHAR) AS run_key, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS t, o_orderkey::DOUBLE AS time_s, true AS good_frame, 0 AS run_idx, 0 AS n_clips FROM orders")
def default_columns(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("run_key"), "o_orderkey", F.col("o_orderkey").cast("double").alias("stimulus_time_s"))
    d = connectivity.with_defaults(o)
    return d.select("run_key", "o_orderkey", "t", "time_s", "good_frame", F.col("run_idx").cast("int").alias("run_idx"), F.when(F.col("clip_idx").isNull(), 0).otherwise(1).alias("n_clips"))


@query("SELECT vec_id, round(embedding[4]::DOUBLE, 5) AS x0, round(embedding[2]::DOUBLE, 5) AS x1, round(embedding[1]::DOUBLE, 5) AS x2 FROM embeddings")
def project_nodes(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    wide = extract.to_wide(e, [f"N{k}" for k in range(64)])
    packed = extract.from_wide(wide.select("vec_id", "N3", "N1", "N0"), ["N3", "N1", "N0"])
    return packed.select("vec_id", *[F.round(F.get("v", F.lit(k)).cast("double"), 5).alias(f"x{k}") for k in range(3)])


@query("SELECT CAST(label % 2 AS VARCHAR) AS sub, CAST(count(*) AS BIGINT) AS n_frames, 2016 AS n_edges, true AS same FROM embeddings GROUP BY ALL")
def edge_layouts(spark, sf_dir):
    f = views.embedding_frames(spark, sf_dir)
    packed = connectivity.pearson_packed(f, ["sub"])
    names = [f"n{k:02d}" for k in range(64)]
    back = connectivity.read_edges(connectivity.widen(packed, names), names).withColumnRenamed("edges", "again")
    n = f.groupBy("sub").agg(F.count("*").alias("n_frames"))
    same = F.forall(F.arrays_zip("edges", "again"), lambda p: (p["edges"] == p["again"]) | (F.isnan(p["edges"]) & F.isnan(p["again"])))
    return packed.join(back, "sub").join(n, "sub").select("sub", "n_frames", F.size("again").alias("n_edges"), same.alias("same"))


#: A label image made of the embeddings: 10 voxels in two directions, as many as it takes in the third.
_IMAGE = "SELECT vec_id AS vox_id, vec_id % 10 AS i, vec_id // 10 % 10 AS j, vec_id // 100 AS k, label FROM embeddings"


def _image(spark, sf_dir):
    v = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(v.alias("vox_id"), (v % 10).cast("int").alias("i"), (F.floor(v / 10) % 10).cast("int").alias("j"), F.floor(v / 100).cast("int").alias("k"), F.col("label").cast("int").alias("label"))


@query(f"WITH im AS ({_IMAGE}), g AS (SELECT CAST(a AS INTEGER) AS i, CAST(b AS INTEGER) AS j, CAST(c AS INTEGER) AS k FROM (SELECT unnest(range(0, 7)) AS a), (SELECT unnest(range(0, 7)) AS b), (SELECT unnest(range(0, 3)) AS c)) SELECT g.i, g.j, g.k, CAST(coalesce(im.label, 0) AS INTEGER) AS label FROM g LEFT JOIN im ON im.i = floor(g.i * 1.5 + 1.0 + 0.5) AND im.j = floor(g.j * 1.5 - 2.0 + 0.5) AND im.k = g.k * 2")
def resample_labels(spark, sf_dir):
    to = [[3, 0, 0, 2], [0, 3, 0, -4], [0, 0, 4, 0], [0, 0, 0, 1]]
    out = spatial.resample_labels(_image(spark, sf_dir), [[2, 0, 0, 0], [0, 2, 0, 0], [0, 0, 2, 0], [0, 0, 0, 1]], to, (7, 7, 3))
    return out.select(*[F.col(a).cast("int").alias(a) for a in "ijk"], "label")


@query(f"WITH im AS ({_IMAGE}) SELECT vox_id, CAST(CASE WHEN vox_id % 3 = 0 AND vox_id % 5 IN (1, 2, 4) THEN CASE vox_id % 5 WHEN 1 THEN 25 WHEN 2 THEN 26 ELSE 27 END WHEN label > 0 THEN label ELSE 0 END AS INTEGER) AS label FROM im")
def label_merge_paint(spark, sf_dir):
    cort = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.when(F.col("n_nationkey") == 0, "Background").otherwise(F.col("n_name")).alias("name"))
    sub = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    image = _image(spark, sf_dir)
    inner = image.filter("vox_id % 3 = 0").withColumn("label", (F.col("vox_id") % 5).cast("int"))
    plan = spatial.merge_plan(cort, sub, drop=("EUROPE",))
    return spatial.merge_labels(image.select("vox_id", "label"), inner.select("vox_id", "label"), plan)


@query("SELECT n_nationkey AS node_idx, replace(n_name, ' ', '_') AS \"column\", 'B' AS hemi, count(c_custkey) AS n_voxels FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL")
def user_atlas(spark, sf_dir):
    from nodetide.sources.atlas import get_atlas

    nation = table(spark, sf_dir, "nation")
    nan = F.lit(float("nan"))
    nodes = nation.select(F.col("n_nationkey").alias("node_idx"), (F.col("n_nationkey") + 1).alias("index"), F.col("n_name").alias("name"), nan.alias("x"), nan.alias("y"), nan.alias("z"), F.col("n_regionkey").cast("string").alias("network"))
    membership = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("node_idx"), F.col("c_custkey").alias("vox_id"))
    atlas = get_atlas(spark, "nations", nodes=nodes, membership=membership)
    n = atlas.membership.groupBy("node_idx").agg(F.count("*").alias("n_voxels"))
    return atlas.nodes.join(n, "node_idx", "left").select("node_idx", "column", "hemi", F.coalesce("n_voxels", F.lit(0)).alias("n_voxels"))
