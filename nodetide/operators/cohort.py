"""Runs on disk against the participants table: the join, both anti-joins, and every check before work starts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nodetide.plans.timing import whole_frames

KEYS = ["sub", "task"]


class ValidationError(RuntimeError):
    """All problems of a cohort, one a line."""


def strict_boolean(c: Column) -> Column:
    """true/false, yes/no, t/f, y/n and 1/0 in any case; anything else is an error, null stays null."""
    s = F.lower(F.trim(c.cast("string")))
    return F.when(s.isNull(), F.lit(None).cast("boolean")).when(s.isin("true", "t", "yes", "y", "1"), True).when(s.isin("false", "f", "no", "n", "0"), False).otherwise(F.raise_error(F.concat(F.lit("not a boolean: "), s)).cast("boolean"))


def attach_participants(runs: DataFrame, participants: DataFrame, trim_column: str | None = None, trim_unit: str = "seconds", tr: float = 1.0) -> DataFrame:
    """Runs that have an analysable row, with its columns; of several rows of a run the first in the table counts (row_no, or participant_id without that), also
    if it says that the run is excluded. trim_end_s is in seconds, converted once."""
    order = "row_no" if "row_no" in participants.columns else "participant_id"
    first = participants.withColumn("_n", F.row_number().over(W.partitionBy(*KEYS).orderBy(order))).filter("_n = 1")
    first = first.filter(~F.coalesce("excluded", F.lit(False))).drop("_n", "cohort", "row_no")
    joined = runs.join(first, KEYS)
    if trim_column is None:
        return joined
    end = F.col(trim_column).cast("double")
    return joined.withColumn("trim_end_s", end * tr if trim_unit == "tr" else end)


def only_on_disk(runs: DataFrame, participants: DataFrame) -> DataFrame:
    """Keys of runs without any row."""
    return runs.select(*KEYS).distinct().join(participants, KEYS, "left_anti")


def only_in_table(runs: DataFrame, participants: DataFrame) -> DataFrame:
    """Keys of analysable rows without a run."""
    return participants.filter(~F.coalesce("excluded", F.lit(False))).select(*KEYS).distinct().join(runs, KEYS, "left_anti")


def duplicate_keys(table: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return table.groupBy(*keys).agg(F.count("*").alias("n_rows")).filter("n_rows > 1")


def without_reason(participants: DataFrame) -> DataFrame:
    """Excluded rows without a reason; a table without that column has none at all."""
    reason = F.col("exclusion_reason") if "exclusion_reason" in participants.columns else F.lit(None).cast("string")
    return participants.filter(F.coalesce("excluded", F.lit(False)) & reason.isNull())


def partial_trims(participants: DataFrame, column: str, tr: float) -> DataFrame:
    return participants.filter(F.col(column).isNotNull() & ~whole_frames(F.col(column).cast("double"), F.lit(tr)))


def problems(runs: DataFrame, participants: DataFrame, cohort: str, tr: float, durations: dict[str, float], trim_column: str | None = None, trim_unit: str = "seconds", examples: int = 5) -> DataFrame:
    """check (its place in order), problem and n, one row per check that fails; examples are the first `examples` keys."""
    text = lambda keys: F.concat_ws(", ", F.slice(F.sort_array(F.collect_set(F.concat_ws("/", *keys))), 1, examples))

    def found(place: int, what: str, rows: DataFrame, keys: list[str]) -> DataFrame:
        return rows.agg(F.count("*").alias("n"), text(keys).alias("e")).filter("n > 0").select(F.lit(place).alias("check"), F.concat(F.lit(f"{what}: "), F.col("e")).alias("problem"), "n")

    cohorts = participants.select("cohort").distinct()
    checks = [
        found(1, "rows of another cohort", cohorts.filter(~F.col("cohort").eqNullSafe(F.lit(cohort))), ["cohort"]),
        found(2, "duplicate (sub, task) keys", duplicate_keys(participants), KEYS),
        found(3, "runs on disk without a row", only_on_disk(runs, participants), KEYS),
        found(4, "analysable rows without a run", only_in_table(runs, participants), KEYS),
        found(5, "excluded rows without a reason", without_reason(participants), KEYS),
        found(8, "runs that share a key", duplicate_keys(runs, [c for c in ("task", "sub", "ses", "run", "acq") if c in runs.columns]), KEYS),
    ]
    if trim_column and trim_column in participants.columns and trim_unit == "seconds":
        checks.append(found(6, f"{trim_column} isn't a whole number of frames", partial_trims(participants, trim_column, tr), KEYS))
    if not trim_column:
        checks.append(found(7, "tasks without a stimulus duration", runs.select("task").distinct().filter(~F.col("task").isin(*durations) if durations else F.lit(True)), ["task"]))
    return reduce(DataFrame.unionByName, checks).orderBy("check")


def validate(found: DataFrame, strict: bool = True) -> list[str]:
    """The problems as text; strict raises if there are any."""
    out = [r.problem for r in found.collect()]  # at most one row a check
    if out and strict:
        raise ValidationError("cohort validation failed:\n  - " + "\n  - ".join(out))
    return out


def shard(rows: DataFrame, index: int, count: int, order: list[str]) -> DataFrame:
    """Every count-th row from `index` on, in order.

    Rows are sorted into ranges; a row's place is its place in its range after the rows of the ranges before it, so no task holds all rows. The ranges are kept
    while their sizes are counted, as another run of the plan may draw them anew."""
    if not 0 <= index < count:
        raise ValueError("shard index must be in [0, count)")
    ranges = rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()).persist()
    before, offsets = 0, []
    for r in ranges.groupBy("_range").count().orderBy("_range").collect():  # a row for each range
        offsets += [F.lit(r["_range"]), F.lit(before)]
        before += r["count"]
    if not offsets:
        return rows.limit(0)
    place = F.element_at(F.create_map(*offsets), F.col("_range")) + F.row_number().over(W.partitionBy("_range").orderBy(*order)) - 1
    return ranges.withColumn("_r", place).filter(F.col("_r") % count == index).drop("_r", "_range")


def attach_by_entities(runs: DataFrame, files: DataFrame, column: str, name: str) -> DataFrame:
    """Runs with the file (files: path, sub, task, ...) of exactly their entities; runs without one keep null."""
    on = [c for c in ("sub", "task", "ses", "run", "acq") if c in files.columns and c in runs.columns]
    one = files.groupBy(*on).agg(F.min(column).alias(name))
    cond = reduce(lambda a, b: a & b, [runs[c].eqNullSafe(one[c]) for c in on])
    return runs.join(one, cond, "left").select(*[runs[c] for c in runs.columns], one[name])
