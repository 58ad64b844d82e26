"""Which voxels belong to which node: labels, spheres, centroids, merges and resampling.

The distance join is an equi-join on grid cells as wide as the radius: a point meets seeds in its own and the 26 neighbouring
cells only, and the exact distance decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nodetide.functions.names import clean_name, hemisphere
from nodetide.operators.extract import small

# Nuisance compartments of the subcortical label list.
NUISANCE = ("Background", "Left Cerebral White Matter", "Right Cerebral White Matter", "Left Cerebral Cortex", "Right Cerebral Cortex", "Left Lateral Ventricle", "Right Lateral Ventricle")


def affine_world(affine: list[list[float]], i: Column, j: Column, k: Column) -> list[Column]:
    """World x, y, z of voxel (i, j, k)."""
    return [F.lit(r[0]) * i + F.lit(r[1]) * j + F.lit(r[2]) * k + F.lit(r[3]) for r in affine[:3]]


def affine_voxel(affine: list[list[float]], x: Column, y: Column, z: Column) -> list[Column]:
    """Fractional voxel coordinates of a world point."""
    import numpy as np

    return affine_world(np.linalg.inv(np.array(affine, float)).tolist(), x, y, z)


def label_membership(label_image: DataFrame, nodes: DataFrame) -> DataFrame:
    """label_image(vox_id, label) and nodes(node_idx, index) -> node_idx, vox_id."""
    return label_image.join(small(nodes.select("node_idx", F.col("index").alias("label"))), "label").select("node_idx", "vox_id")


def within_radius(points: DataFrame, seeds: DataFrame, radius: float) -> DataFrame:
    """points(vox_id, x, y, z) and seeds(seed_idx, node_idx, sx, sy, sz) -> node_idx, seed_idx, vox_id with distance at most radius. Keeps duplicates of a node."""
    cell = lambda c: F.floor(F.col(c) / radius).cast("int")
    s = seeds
    for axis in "xyz":
        c = cell(f"s{axis}")
        s = s.withColumn(f"c{axis}", F.explode(F.array(c - 1, c, c + 1)))
    p = points.withColumns({f"c{axis}": cell(axis) for axis in "xyz"})
    d2 = sum(((F.col(a) - F.col(f"s{a}")) * (F.col(a) - F.col(f"s{a}")) for a in "xyz"), F.lit(0.0))
    return p.join(s, ["cx", "cy", "cz"]).filter(d2 <= radius * radius).select("node_idx", "seed_idx", "vox_id")


def sphere_membership(points: DataFrame, seeds: DataFrame, radius: float = 5.0) -> DataFrame:
    """node_idx, vox_id: a voxel that several seeds of a node cover comes once for each."""
    return within_radius(points, seeds, radius).select("node_idx", "vox_id")


def label_centroids(label_image: DataFrame, nodes: DataFrame, affine: list[list[float]]) -> DataFrame:
    """World centroid of each node's label; NaN where the image lacks it."""
    mean = label_image.groupBy("label").agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in "ijk"])
    world = affine_world(affine, F.col("i"), F.col("j"), F.col("k"))
    placed = mean.select("label", *[w.alias(a) for w, a in zip(world, "xyz", strict=True)])
    nan = F.lit(float("nan"))
    return nodes.join(placed, nodes["index"] == placed["label"], "left").select(*[nodes[c] for c in nodes.columns if c not in "xyz"], *[F.coalesce(placed[a], nan).alias(a) for a in "xyz"])


def label_table(names: DataFrame) -> DataFrame:
    """names(index, name, network) with node_idx, hemi and column, in index order."""
    order = W.orderBy("index")  # a label table is one small table
    return names.withColumns({"node_idx": (F.row_number().over(order) - 1).cast("int"), "hemi": hemisphere(F.col("name")), "column": clean_name(F.col("name"))})


def label_problems(nodes: DataFrame) -> DataFrame:
    """kind and value of duplicate indices and of names that are equal once cleaned."""
    index = nodes.groupBy("index").count().filter("count > 1").select(F.lit("duplicate index").alias("kind"), F.col("index").cast("string").alias("value"))
    name = nodes.groupBy(clean_name(F.col("name")).alias("value")).count().filter("count > 1").select(F.lit("duplicate name").alias("kind"), "value")
    return index.unionByName(name)


def auto_labels(label_image: DataFrame) -> DataFrame:
    """index and name of every label but 0, named parcel_001 and so on by value."""
    return label_image.filter("label != 0").select(F.col("label").alias("index")).distinct().withColumn("name", F.format_string("parcel_%03d", F.col("index").cast("int"))).withColumn("network", F.lit("unknown"))


def merge_plan(cortical: DataFrame, subcortical: DataFrame, drop: tuple[str, ...] = NUISANCE) -> DataFrame:
    """(id, name) lists, id 0 first -> part, old_id, new_id, name. Cortical ids stay as they are without a leading background; the subcortical
    ones that aren't dropped follow in order."""
    background = F.lower("name").isin("background", "") & (F.col("id") == 0)
    cort = cortical.filter(~background).select(F.lit("cort").alias("part"), F.col("id").alias("old_id"), "name")
    cort = cort.withColumn("new_id", F.row_number().over(W.orderBy("old_id")))
    n = cort.select(F.count("*").alias("n_cort"))
    sub = subcortical.filter((F.col("id") != 0) & ~F.col("name").isin(*drop)).select(F.lit("sub").alias("part"), F.col("id").alias("old_id"), "name")
    sub = sub.withColumn("place", F.row_number().over(W.orderBy("old_id"))).crossJoin(F.broadcast(n)).withColumn("new_id", (F.col("place") + F.col("n_cort")).cast("int"))
    return cort.select("part", "old_id", "new_id", "name").unionByName(sub.select("part", "old_id", "new_id", "name"))


def merge_labels(cort_image: DataFrame, sub_image: DataFrame, plan: DataFrame) -> DataFrame:
    """vox_id, label of the merged image: where both have a label, the subcortical one wins; voxels without a label are 0."""
    of = lambda part: small(plan.filter(F.col("part") == part).select(F.col("old_id").alias("label"), F.col("new_id").alias(part)))
    c = cort_image.join(of("cort"), "label", "left").select("vox_id", "cort")
    s = sub_image.join(of("sub"), "label", "left").select("vox_id", "sub")
    return c.join(s, "vox_id", "full").select("vox_id", F.coalesce("sub", "cort", F.lit(0)).cast("int").alias("label"))


def network_nodes(seeds: DataFrame) -> DataFrame:
    """seeds(ord, network, x, y, z, optional name, description) -> one node per network in order of first appearance, at the mean of its seeds."""
    first = lambda c, other: F.min_by(c, "ord") if c in seeds.columns else other
    g = seeds.groupBy("network").agg(F.min("ord").alias("ord"), *[F.avg(a).alias(a) for a in "xyz"], F.count("*").cast("int").alias("n_seeds"), first("name", F.first("network")).alias("full_name"), first("description", F.first(F.lit(""))).alias("description"))
    order = W.orderBy("ord")
    return g.withColumn("node_idx", (F.row_number().over(order) - 1).cast("int")).select("node_idx", (F.col("node_idx") + 1).alias("index"), F.col("network").alias("name"), F.lit("B").alias("hemi"), "x", "y", "z", "network", "n_seeds", "full_name", "description")


def seed_nodes(seeds: DataFrame) -> DataFrame:
    """One node per seed, named NETWORK_001 by its number, on the side that x says."""
    order = W.orderBy("ord")
    number = F.col("node_number") if "node_number" in seeds.columns else F.row_number().over(order)
    text = lambda c, other: F.col(c).cast("string") if c in seeds.columns else other
    return seeds.withColumn("node_idx", (F.row_number().over(order) - 1).cast("int")).select(
        "node_idx", (F.col("node_idx") + 1).alias("index"), F.format_string("%s_%03d", F.col("network"), number.cast("int")).alias("name"),
        F.when(F.col("x") < 0, "L").when(F.col("x") > 0, "R").otherwise("B").alias("hemi"), "x", "y", "z", "network",
        text("name", F.col("network")).alias("full_name"), text("description", F.lit("")).alias("description"),
    )


def same_grid(shape_a: tuple, affine_a, shape_b: tuple, affine_b) -> bool:
    import numpy as np

    return tuple(shape_a[:3]) == tuple(shape_b[:3]) and bool(np.allclose(affine_a, affine_b, atol=1e-4))


def resample_labels(label_image: DataFrame, from_affine, to_affine, to_shape: tuple[int, int, int]) -> DataFrame:
    """Nearest-neighbour labels (vox_id, i, j, k, label) on another grid; 0 outside. Works voxel by voxel of the target, so it joins on integer places."""
    import numpy as np

    spark = label_image.sparkSession
    ni, nj, nk = (int(s) for s in to_shape)
    m = (np.linalg.inv(np.array(from_affine, float)) @ np.array(to_affine, float)).tolist()
    target = spark.range(ni * nj * nk).withColumnRenamed("id", "vox_id").withColumns({"i": F.floor(F.col("vox_id") / (nj * nk)), "j": F.floor(F.col("vox_id") / nk) % nj, "k": F.col("vox_id") % nk})
    at = affine_world(m, F.col("i"), F.col("j"), F.col("k"))
    target = target.withColumns({f"s{a}": F.floor(c + 0.5).cast("int") for a, c in zip("ijk", at, strict=True)})
    source = label_image.select(*[F.col(a).cast("int").alias(f"s{a}") for a in "ijk"], "label")
    return target.join(source, ["si", "sj", "sk"], "left").select("vox_id", "i", "j", "k", F.coalesce("label", F.lit(0)).cast("int").alias("label"))
