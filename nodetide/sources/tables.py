"""Readers of the small files around a recording: participants, runs on disk, censor lists, confounds, coordinates, scans."""

from __future__ import annotations

import fnmatch
import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodetide.config import CohortConfig
from nodetide.operators.cohort import strict_boolean

RUN_SCHEMA = "cohort string, sub string, task string, path string, mask string, ses string, run string, acq string, timing_source string"
PARTICIPANT_COLUMNS = ("participant_id", "sub", "cohort", "task", "excluded")


def participants(spark: SparkSession, path: str) -> DataFrame:
    """The participants table, with row_no in the order of its rows. Every column is read as text, so ids keep their zeros; `movie` is an older name of `task`; excluded is parsed strictly."""
    df = spark.read.option("header", True).option("inferSchema", False).csv(path)
    if "movie" in df.columns and "task" not in df.columns:
        df = df.withColumnRenamed("movie", "task")
    if missing := [c for c in PARTICIPANT_COLUMNS if c not in df.columns]:
        raise ValueError(f"participants table lacks {', '.join(missing)}")
    return df.withColumn("excluded", strict_boolean(F.col("excluded"))).withColumn("row_no", F.monotonically_increasing_id())


#: How file names spell an entity in BIDS: key-value between underscores.
BIDS_ENTITY = "(?:^|_){}-([A-Za-z0-9]+)(?=_)"


def discover_from_paths(paths: DataFrame, cfg: CohortConfig) -> DataFrame:
    """paths(path) -> runs. The subject is looked for in the whole path, the other entities in the file's name; the BIDS backend goes by the entities of the name alone."""
    d = cfg.discovery
    name = F.substring_index("path", "/", -1)
    bids = d.backend == "pybids"
    subject = (BIDS_ENTITY.format("sub"), name) if bids else (d.subject_pattern, F.col("path"))
    task = BIDS_ENTITY.format("task") if bids else d.task_pattern
    more = BIDS_ENTITY if bids else "{}-([A-Za-z0-9]+)"
    entity = lambda pattern, of: F.nullif(F.regexp_extract(of, pattern, 1), F.lit(""))
    rows = paths.select(
        F.lit(cfg.cohort).alias("cohort"), entity(*subject).alias("sub"), entity(task, name).alias("task"), "path",
        F.lit(None).cast("string").alias("mask"), *[entity(more.format(k), name).alias(k) for k in ("ses", "run", "acq")], F.lit(cfg.stimulus.timing_source).alias("timing_source"),
    ).filter(F.col("sub").isNotNull() & F.col("task").isNotNull())
    if d.include_tasks:
        rows = rows.filter(F.col("task").isin(*d.include_tasks))
    if d.exclude_tasks:
        rows = rows.filter(~F.col("task").isin(*d.exclude_tasks))
    return rows.orderBy("path")


def discover(spark: SparkSession, cfg: CohortConfig) -> DataFrame:
    """Runs below derivatives_root in path order: by the glob of the configuration, with the first mask that fits; or, with the BIDS backend, all *_bold.nii.gz at any depth by
    the entities of their names, without masks."""
    if cfg.discovery.backend not in ("glob", "pybids"):
        raise ValueError(f"unknown discovery backend {cfg.discovery.backend!r}")
    root = cfg.derivatives_root.rstrip("/")
    reader = spark.read.format("binaryFile")
    found = reader.option("recursiveFileLookup", True).option("pathGlobFilter", "*_bold.nii.gz").load(root) if cfg.discovery.backend == "pybids" else reader.load(f"{root}/{cfg.discovery.bold_glob}")
    files = found.select(F.regexp_replace("path", "^file:", "").alias("path"))  # names only: content is pruned
    runs = discover_from_paths(files, cfg)
    if cfg.discovery.mask_glob and cfg.discovery.backend == "glob":
        folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
        all_masks = spark.read.format("binaryFile").option("pathGlobFilter", re.sub(r"\{[a-z]+\}", "*", os.path.basename(cfg.discovery.mask_glob))).option("recursiveFileLookup", True).load(cfg.derivatives_root)
        masks = all_masks.select(F.regexp_replace("path", "^file:", "").alias("m")).withColumns({"mf": F.regexp_extract("m", "^(.*)/[^/]*$", 1), "mn": F.substring_index("m", "/", -1)})
        like = fnmatch.translate(cfg.discovery.mask_glob).removeprefix("(?s:").removesuffix(r")\Z").removesuffix(r")\z")
        wanted = F.lit(like)
        for k in ("sub", "task"):
            wanted = F.replace(wanted, F.lit(re.escape("{" + k + "}")), F.col(k))
        hit = runs.withColumns({"f": folder, "w": wanted}).join(masks, (F.col("f") == F.col("mf")) & F.expr("regexp_like(mn, concat('^', w, '$'))"), "left").groupBy("path").agg(F.min("m").alias("mask"))
        runs = runs.drop("mask").join(hit, "path", "left").select(*runs.columns).orderBy("path")
    return runs


def censor(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, t, keep of one-column text files: above 0.5 keeps. Lines keep their order in the file; blank lines and # comments don't count."""
    whole = spark.read.text(paths, wholetext=True).select(F.regexp_replace(F.input_file_name(), "^file:/+", "/").alias("path"), "value")
    lines = F.filter(F.transform(F.split("value", r"\r?\n"), lambda x: F.trim(F.regexp_replace(x, "#.*", ""))), lambda x: x != "")
    return whole.select("path", F.posexplode(lines).alias("t", "x")).select("path", "t", (F.col("x").cast("double") > 0.5).alias("keep"))


def confounds(spark: SparkSession, path: str, kind: str, n_tr: int, columns: tuple[str, ...] = ()) -> DataFrame:
    """t and c (array<double>) of a confounds table: afni_1D text or fmriprep_tsv; not-a-number counts as 0; a table that lies on its side is turned."""
    if kind == "fmriprep_tsv":
        text = spark.read.text(path, wholetext=True).first()[0]
        head = text.splitlines()[0].split("\t")
        names = list(columns or head)
        rows = [[line.split("\t")[head.index(c)] for c in names] for line in text.splitlines()[1:] if line.strip()]
    elif kind == "afni_1D":
        rows = [line.split("#")[0].split() for line in spark.read.text(path, wholetext=True).first()[0].splitlines() if line.split("#")[0].strip()]
    else:
        raise ValueError(f"unsupported confounds format {kind!r}")

    def number(x: str) -> float:
        try:
            v = float(x)
        except ValueError:
            return 0.0
        return 0.0 if v != v else max(min(v, 1.7976931348623157e308), -1.7976931348623157e308)

    values = [[number(x) for x in r] for r in rows]
    if len(values) != n_tr:
        values = [list(x) for x in zip(*values, strict=True)]
    if len(values) != n_tr:
        raise ValueError(f"confounds have {len(values)} rows, not {n_tr}")
    return spark.createDataFrame(list(enumerate(values)), "t int, c array<double>")


def coordinates(spark: SparkSession, path: str) -> DataFrame:
    """Seeds: ord, network, x, y, z and, where there are, node_number, name, description. Header names are trimmed."""
    raw = spark.read.option("header", True).csv(path)
    df = raw.toDF(*[c.strip() for c in raw.columns])
    if "node number" in df.columns:
        df = df.withColumnRenamed("node number", "node_number")
    if missing := [c for c in ("network", "x", "y", "z") if c not in df.columns]:
        raise ValueError(f"coordinate table lacks {', '.join(missing)}")
    df = df.withColumns({c: F.col(c).cast("double") for c in "xyz"})
    return df.withColumn("ord", F.monotonically_increasing_id())


def scans(spark: SparkSession, path: str) -> DataFrame:
    """sub, task, run, acq_s, n_vols and drop_after_restart (0 if absent) rows in run order; acq_time_s is another name of acq_s."""
    df = spark.read.option("header", True).option("sep", "\t" if path.endswith(".tsv") else ",").csv(path)
    if "acq_time_s" in df.columns and "acq_s" not in df.columns:
        df = df.withColumnRenamed("acq_time_s", "acq_s")
    drop = F.coalesce(F.col("drop_after_restart").cast("int"), F.lit(0)) if "drop_after_restart" in df.columns else F.lit(0)
    return df.withColumns({"acq_s": F.col("acq_s").cast("double"), "n_vols": F.col("n_vols").cast("int"), "drop_after_restart": drop}).orderBy("sub", "task", "run")
