"""The driver's tables in the shape of activation tables, as DataFrames and as SQL with the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodetide.operators.extract import small

HOURS = 720
_HOUR = "datediff(CAST(ts AS DATE), DATE '2024-01-01') * 24 + hour(ts)"

#: h, sub, node, x: sums of event values by hour since 2024-01-01, on a dense grid; bad hours have error events.
SQL_EVENTS = f"""
ev AS (SELECT date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) * 24 + hour(ts) AS h, CAST(user_id % 4 AS VARCHAR) AS sub, event_type, value FROM events),
types AS (SELECT event_type, CAST(row_number() OVER (ORDER BY event_type) - 1 AS INTEGER) AS node FROM (SELECT DISTINCT event_type FROM events)),
sums AS (SELECT h, sub, event_type, sum(value) AS x FROM ev GROUP BY ALL),
act AS (SELECT CAST(g.h AS INTEGER) AS t, s.sub, types.node, types.event_type, coalesce(sums.x, 0.0) AS x FROM (SELECT unnest(range(0, {HOURS})) AS h) g
 CROSS JOIN (SELECT CAST(unnest(range(0, 4)) AS VARCHAR) AS sub) s CROSS JOIN types LEFT JOIN sums ON sums.h = g.h AND sums.sub = s.sub AND sums.event_type = types.event_type),
bad AS (SELECT DISTINCT sub, CAST(h AS INTEGER) AS t FROM ev WHERE event_type = 'error' AND h % 7 = 0),
frames AS (SELECT a.*, b.t IS NULL AS good_frame FROM (SELECT DISTINCT t, sub FROM act) a LEFT JOIN bad b ON a.t = b.t AND a.sub = b.sub)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """h, sub, event_type, value of each event."""
    return table(spark, sf_dir, "events").select(F.expr(_HOUR).cast("int").alias("h"), (F.col("user_id") % 4).cast("string").alias("sub"), "event_type", "value")


def event_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node_idx and event_type in name order (the few kinds of events)."""
    kinds = table(spark, sf_dir, "events").select("event_type").distinct()
    return kinds.agg(F.sort_array(F.collect_set("event_type")).alias("k")).select(F.posexplode("k").alias("node_idx", "event_type"))


def event_activation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_key (= sub), sub, task, t, node_idx, event_type, x on the dense grid of hours, subjects and kinds."""
    sums = events_by_hour(spark, sf_dir).groupBy("h", "sub", "event_type").agg(F.sum("value").alias("x"))
    nodes = small(event_nodes(spark, sf_dir))
    grid = spark.range(HOURS).select(F.col("id").cast("int").alias("t"), F.explode(F.array(*[F.lit(str(i)) for i in range(4)])).alias("sub")).crossJoin(nodes)
    full = grid.join(sums.withColumnRenamed("h", "t"), ["t", "sub", "event_type"], "left")
    return full.select(F.col("sub").alias("run_key"), "sub", F.lit("events").alias("task"), "t", "node_idx", "event_type", F.coalesce("x", F.lit(0.0)).alias("x"))


def event_bad_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_key, t of hours divisible by 7 with an error event."""
    return events_by_hour(spark, sf_dir).filter("event_type = 'error' AND h % 7 = 0").select(F.col("sub").alias("run_key"), F.col("h").alias("t")).distinct()


def event_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed form: run_key, sub, task, t, time_s, stimulus_time_s, good_frame, run_idx, v."""
    from nodetide.plans.timing import censor_mask

    long = event_activation(spark, sf_dir)
    packed = long.groupBy("run_key", "sub", "task", "t").agg(F.transform(F.sort_array(F.collect_list(F.struct("node_idx", "x"))), lambda s: s["x"].cast("float")).alias("v"))
    d = packed.withColumns({"time_s": F.col("t").cast("float"), "stimulus_time_s": F.col("t").cast("float"), "run_idx": F.floor(F.col("t") / 240).cast("byte")})
    return censor_mask(d, event_bad_frames(spark, sf_dir), dilate_tr=0)


def embedding_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sub (label % 2), t (place of vec_id within sub), v."""
    from pyspark.sql import Window as W

    e = table(spark, sf_dir, "embeddings").withColumn("sub", (F.col("label") % 2).cast("string"))
    return e.withColumn("t", (F.row_number().over(W.partitionBy("sub").orderBy("vec_id")) - 1).cast("int")).select("sub", F.col("sub").alias("run_key"), "t", F.lit(True).alias("good_frame"), F.col("embedding").alias("v"))
