"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators between words, and words, as Java, RE2 and Python patterns.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a batch that goes to a Python worker. Spark's own 64 MB are held on both sides at once, by every task.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches for this session, unless somebody has chosen still smaller ones."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, None)
    if now is None or not now.rstrip("bB").isdigit() or int(now.rstrip("bB")) > BATCH_BYTES:
        spark.conf.set(name, f"{BATCH_BYTES}b")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is named and all runs on this machine (local tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.conf.get("spark.master", "local").startswith("local") or spark.conf.get("spark.master", "").startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='nodetide-')}"
        atexit.register(shutil.rmtree, named.removeprefix("file://"), True)
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


#: Folders that this process has written, in order.
_WRITTEN: list[str] = []


def new_folder(spark: SparkSession, what: str) -> str:
    """A new place in the shared folder, which `release` deletes."""
    bound_batches(spark)
    path = f"{shared_dir(spark)}/nodetide-{what}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def written() -> int:
    """How many folders there have been, for `release`."""
    return len(_WRITTEN)


def release(spark: SparkSession, since: int = 0, upto: int | None = None, keep: tuple[str, ...] = ()) -> None:
    """Deletes the folders written from `since` to `upto`, but those whose name begins with nodetide- and one of `keep`. Only for results that are stored elsewhere by then."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    for at in range(since, len(_WRITTEN) if upto is None else upto):
        folder = _WRITTEN[at]
        if folder and not folder.rsplit("/", 1)[1].startswith(tuple(f"nodetide-{k}" for k in keep) or ("\0",)):
            p = path(folder)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
            _WRITTEN[at] = ""


def cut(df: DataFrame, what: str) -> DataFrame:
    """Write `df` once to the shared folder and read it back: later stages start from files that outlive executors."""
    spark = df.sparkSession
    path = new_folder(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def words(text: Column) -> Column:
    """Array of the words of a text; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), F.lit(f"{SPACE}+")), "")
