"""Names and keys as Column expressions: labels, hemispheres, run keys, path keys, edges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_name(s: Column) -> Column:
    """Trimmed; space to _, / to -, and , ' ( ) gone."""
    return F.translate(F.trim(s), " /,'()", "_-")


def hemisphere(s: Column) -> Column:
    """L, R or B by how the name begins or ends."""
    low = F.lower(s)
    side = lambda word, letter: low.startswith(word) | low.endswith(f" {letter}") | low.contains(f"_{word}")
    return F.when(side("left", "l"), "L").when(side("right", "r"), "R").otherwise("B")


def hemisphere_stem(s: Column) -> Column:
    """The name without a leading Left or Right and the blanks or underscores after it."""
    return F.regexp_replace(s, r"^(Left|Right)[\s_]+", "")


def run_key(cohort: Column, sub: Column, task: Column, ses: Column, run: Column, acq: Column) -> Column:
    """cohort-_sub-_task-[_ses-][_run-][_acq-]; null and empty entities are left out."""
    part = lambda name, c: F.when(c.isNotNull() & (c != ""), F.concat(F.lit(f"{name}-"), c))
    return F.concat_ws("_", *(part(n, c) for n, c in (("cohort", cohort), ("sub", sub), ("task", task), ("ses", ses), ("run", run), ("acq", acq))))


def path_key(s: Column) -> Column:
    """A value as a path key: / \\ = and space become -."""
    return F.translate(s, "/\\= ", "----")


def leaf_name(ses: Column, run: Column, acq: Column) -> Column:
    part = lambda name, c: F.when(c.isNotNull() & (c != ""), F.concat(F.lit(f"{name}-"), path_key(c)))
    made = F.concat_ws("_", part("ses", ses), part("run", run), part("acq", acq))
    return F.concat(F.when(made == "", "data").otherwise(made), F.lit(".parquet"))


def window_key(seconds: Column) -> Column:
    """30.0 as 30 and 2.5 as 2.5."""
    return F.when(seconds == F.floor(seconds), F.floor(seconds).cast("string")).otherwise(seconds.cast("string"))


def n_edges(n: Column) -> Column:
    return F.floor(n * (n - 1) / 2).cast("long")


def edge_index(i: Column, j: Column, n: Column | int) -> Column:
    """Place of edge (i, j), i < j, in the row-major upper triangle of an n x n matrix."""
    n = F.lit(n) if isinstance(n, int) else n
    return (F.floor(i * (2 * n - i - 1) / 2) + (j - i - 1)).cast("int")


def edge_name(a: Column, b: Column) -> Column:
    return F.concat(a, F.lit("__"), b)


def fisher_z(r: Column) -> Column:
    return F.atanh(r)


def half_up(x: Column) -> Column:
    """floor(x + 1/2)."""
    return F.floor(x + 0.5).cast("int")


def is_finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def hive_keys(path: Column) -> Column:
    """A map of the k=v parts of a path; the last of equal keys wins."""
    parts = F.filter(F.split(path, "/"), lambda p: p.contains("="))
    pairs = F.transform(parts, lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.substr(p, F.instr(p, "=") + 1).alias("v")))
    last = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs) - i - 1, F.lit(0))), lambda y: y["k"] == x["k"]))
    return F.map_from_entries(last)
