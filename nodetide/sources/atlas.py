"""Atlases by name: node tables with their membership, from label images, label tables or coordinate seeds."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodetide.functions.names import clean_name, hemisphere
from nodetide.operators import spatial
from nodetide.sources import nifti, tables

LABEL_COLUMNS = ("index", "name", "hemi", "x", "y", "z", "network")


@dataclass
class Atlas:
    """nodes(node_idx, index, name, hemi, x, y, z, network, column) and membership(node_idx, vox_id), a multiset."""

    name: str
    kind: str
    nodes: DataFrame
    membership: DataFrame
    provenance: dict = field(default_factory=dict)

    def check(self) -> Atlas:
        if missing := [c for c in LABEL_COLUMNS if c not in self.nodes.columns]:
            raise ValueError(f"label table of {self.name} lacks {', '.join(missing)}")
        bad = spatial.label_problems(self.nodes).limit(5).collect()
        if bad:
            raise ValueError(f"{self.name}: " + ", ".join(f"{r.kind} {r.value}" for r in bad))
        return self

    @property
    def n_nodes(self) -> int:
        return self.nodes.count()

    def columns(self) -> list[str]:
        return [r[0] for r in self.nodes.orderBy("node_idx").select("column").collect()]


def label_atlas(spark: SparkSession, name: str, label_image: str, labels_csv: str | None = None, network: str = "unknown", names: tuple[str, ...] | list[str] = (), **_) -> Atlas:
    """From a 3D label image and, if given, a table of index, name and network, or the names of labels 1, 2 and so on, each a network; else the labels name themselves."""
    image, head = nifti.label_image(spark, label_image)
    if names and not labels_csv:
        names = spark.createDataFrame([(k, n, n) for k, n in enumerate(names, 1)], "index int, name string, network string")
    elif labels_csv:
        names = spark.read.option("header", True).csv(labels_csv)
        names = names.select(F.col("index").cast("int").alias("index"), "name", (F.col("network") if "network" in names.columns else F.lit(network)).alias("network"))
    else:
        names = spatial.auto_labels(image)
    nodes = spatial.label_centroids(image, spatial.label_table(names), [list(r) for r in head.affine])
    return Atlas(name, "labels", nodes, spatial.label_membership(image, nodes), {"label_image": label_image, "labels_csv": labels_csv}).check()


def sphere_atlas(spark: SparkSession, name: str, csv: str, reference: str, aggregate: str = "network", radius_mm: float = 5.0, **_) -> Atlas:
    """From coordinate seeds: one node per network, or per seed, of all voxels of the reference grid within the radius."""
    if aggregate not in ("network", "node"):
        raise ValueError(f"aggregate must be network or node, not {aggregate!r}")
    seeds = tables.coordinates(spark, csv)
    nodes = spatial.network_nodes(seeds) if aggregate == "network" else spatial.seed_nodes(seeds)
    nodes = nodes.withColumn("column", clean_name(F.col("name")))
    number = seeds.withColumn("seed_idx", F.col("ord").cast("int"))
    owner = number.join(nodes.select("node_idx", F.col("network").alias("_n")), F.col("network") == F.col("_n")) if aggregate == "network" else number.withColumn("node_idx", F.col("seed_idx"))
    placed = owner.select("seed_idx", "node_idx", *[F.col(a).alias(f"s{a}") for a in "xyz"])
    grid, head = reference_grid(spark, reference)
    return Atlas(name, "spheres", nodes, spatial.sphere_membership(grid, placed, radius_mm), {"csv": csv, "aggregate": aggregate, "radius_mm": radius_mm}).check()


def merged_atlas(spark: SparkSession, name: str, cort_image: str, sub_image: str, cort_labels: str, sub_labels: str, drop: tuple[str, ...] | list[str] = spatial.NUISANCE, **_) -> Atlas:
    """From a cortical and a subcortical label image with their lists (CSV of id, name): the subcortical image is brought to the other's grid, dropped compartments go,
    and subcortical labels win where both have one."""
    cort, head = nifti.label_image(spark, cort_image)
    inner, sub_head = nifti.label_image(spark, sub_image)
    if not spatial.same_grid(head.shape, head.affine, sub_head.shape, sub_head.affine):
        inner = spatial.resample_labels(inner, sub_head.affine, head.affine, head.shape[:3])
    names = lambda path: spark.read.option("header", True).csv(path).select(F.col("id").cast("int").alias("id"), F.trim("name").alias("name"))
    plan = spatial.merge_plan(names(cort_labels), names(sub_labels), tuple(drop))
    labels = spatial.merge_labels(cort.select("vox_id", "label"), inner.select(F.col("vox_id").cast("long").alias("vox_id"), "label"), plan)
    image = cort.drop("label").join(labels, "vox_id")
    table = spatial.label_table(plan.select(F.col("new_id").cast("int").alias("index"), "name", F.when(F.col("part") == "cort", "cortical").otherwise("subcortical").alias("network")))
    nodes = spatial.label_centroids(image, table, [list(r) for r in head.affine])
    return Atlas(name, "labels", nodes, spatial.label_membership(image, nodes), {"cort_image": cort_image, "sub_image": sub_image, "dropped": sorted(drop)}).check()


def reference_grid(spark: SparkSession, path: str) -> tuple[DataFrame, nifti.Header]:
    """Voxel centres vox_id, x, y, z of an image's grid (from its header), and the header."""
    with nifti._open(path) as f:
        head = nifti.parse_header(f.read(352))
    ni, nj, nk = head.shape[:3]
    v = spark.range(ni * nj * nk).select(F.col("id").alias("vox_id"), F.floor(F.col("id") / (nj * nk)).alias("i"), (F.floor(F.col("id") / nk) % nj).alias("j"), (F.col("id") % nk).alias("k"))
    xyz = spatial.affine_world([list(r) for r in head.affine], F.col("i"), F.col("j"), F.col("k"))
    return v.select("vox_id", *[c.cast("double").alias(a) for c, a in zip(xyz, "xyz", strict=True)]), head


def table_atlas(spark: SparkSession, name: str, nodes: DataFrame, membership: DataFrame, **_) -> Atlas:
    """From a user's own DataFrames."""
    nodes = nodes if "hemi" in nodes.columns else nodes.withColumn("hemi", hemisphere(F.col("name")))
    nodes = nodes if "column" in nodes.columns else nodes.withColumn("column", clean_name(F.col("name")))
    return Atlas(name, "labels", nodes, membership).check()


REGISTRY: dict[str, Callable[..., Atlas]] = {}
#: Other names of the same atlases. Their images aren't part of this package; parameters name them.
ALIASES = {
    "ho": "harvardoxford", "harvardoxford111": "harvardoxford", "ho69": "harvardoxford69", "legacy69": "harvardoxford69", "harvardoxfordlegacy69": "harvardoxford69", "yeo": "yeo7", "yeo2011": "yeo7",
    "networks14": "networks", "coordnetworks": "networks", "networks254": "networks_nodes", "nodes": "networks_nodes", "networksnodes": "networks_nodes",
}
# The seven networks in the order of their labels.
YEO_NETWORKS = ("Visual", "Somatomotor", "DorsalAttention", "VentralAttention", "Limbic", "Frontoparietal", "Default")
#: What an atlas is made with, unless its parameters say otherwise: the older one of 69 keeps all compartments but the background.
BUILT_IN: dict[str, dict] = {"harvardoxford": {}, "harvardoxford69": {"drop": ("Background",)}, "yeo7": {"names": YEO_NETWORKS}, "networks": {"aggregate": "network"}, "networks_nodes": {"aggregate": "node"}}


def register(name: str, make: Callable[..., Atlas]) -> None:
    REGISTRY[name] = make


def get_atlas(spark: SparkSession, name: str, **params) -> Atlas:
    """A registered atlas, or one that its parameters describe: label_image, cort_image with sub_image, csv with reference, or nodes with membership."""
    plain = name.lower().replace("-", "").replace("_", "")
    name = ALIASES.get(plain, plain if plain in BUILT_IN else name)
    if name in REGISTRY:
        return REGISTRY[name](spark, name, **params)
    params = {**BUILT_IN.get(name, {}), **params}
    if "cort_image" in params:
        return merged_atlas(spark, name, **params)
    if "label_image" in params:
        return label_atlas(spark, name, **params)
    if "csv" in params:
        return sphere_atlas(spark, name, **params)
    if "nodes" in params:
        return table_atlas(spark, name, **params)
    if name in BUILT_IN:
        raise KeyError(f"the images of atlas {name!r} aren't part of this package; give label_image, cort_image with sub_image, cort_labels and sub_labels, or csv with reference")
    raise KeyError(f"unknown atlas {name!r}; give label_image, cort_image, csv or nodes")
