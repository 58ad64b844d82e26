"""Repeated byte strings by prefix doubling with rows: Spark sorts pairs of ranks of positions at growing offsets.

    positions  every byte that at least FIRST bytes of its text follow, with those bytes as two integers, which rank them exactly
    a round    equal pairs get one rank, in the order of the pairs; pairs that one document alone has are unique and their positions go; then each position that is left
               meets the rank at the offset behind it, which makes the pairs of twice the length. The last offset is what the length still asks for.

This is the method as it is named, with a row for each byte through every shuffle. `suffix_dedup` finds the same bytes with a hundredth of the rows; see the README for what
both take.

Defined cases: those of `suffix_dedup`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodetide.llm.common import cut

FIRST = 16


def positions(docs: DataFrame) -> DataFrame:
    """(doc, doc_id, at, x, y): place of a row, its id, and the bytes at `at` as two integers in their order; docs(doc, doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, doc_id, text in zip(b.column("doc").to_pylist(), b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                raw = np.frombuffer(text.as_py() or b"", np.uint8)
                n = len(raw) - FIRST + 1
                if n < 1 or doc_id is None:
                    continue
                # Big-endian words with the sign turned, so that they sort as their bytes do.
                words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(raw, 8)).view(">u8").ravel().astype(np.uint64) ^ np.uint64(1 << 63)
                for lo in range(0, n, 1 << 16):
                    hi = min(n, lo + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array([doc] * (hi - lo), pa.int64()), pa.array([doc_id] * (hi - lo), pa.int64()), pa.array(np.arange(lo, hi, dtype=np.int32)), pa.array(words[lo:hi].view(np.int64)), pa.array(words[lo + 8 : hi + 8].view(np.int64))], ["doc", "doc_id", "at", "x", "y"])

    d = docs.select(F.col("doc").cast("long").alias("doc"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return d.mapInArrow(run, "doc long, doc_id long, at int, x long, y long")


def ranked(pairs: DataFrame) -> DataFrame:
    """(x, y, least, rank) of the pairs that several documents have: ranges of the sorted pairs, numbered within and after each other."""
    shared = pairs.groupBy("x", "y").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least != most").select("x", "y", "least")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        now = TaskContext.get().partitionId() << 40
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("x", "y", "least")), pa.array(np.arange(now, now + b.num_rows))], ["x", "y", "least", "rank"])
            now += b.num_rows

    return cut(shared.repartitionByRange("x", "y").sortWithinPartitions("x", "y").mapInArrow(number, "x long, y long, least long, rank long"), "ranks")


def repeated(docs: DataFrame, length: int = 50) -> DataFrame:
    """(doc, starts): of each row the sorted places where `length` bytes begin that a document with a smaller doc_id has too."""
    if length < FIRST:
        raise ValueError(f"length must be at least {FIRST}")
    live, have = positions(docs), FIRST
    while True:
        live = cut(live, "positions")
        met = live.join(ranked(live), ["x", "y"])
        if have == length:
            return met.filter("doc_id > least").groupBy("doc").agg(F.sort_array(F.collect_list("at")).alias("starts"))
        held = cut(met.select("doc", "doc_id", "at", "rank"), "ranked")
        step = min(have, length - have)
        behind = held.select("doc", (F.col("at") - step).alias("at"), F.col("rank").alias("y"))
        live, have = held.withColumnRenamed("rank", "x").join(behind, ["doc", "at"]).select("doc", "doc_id", "at", "x", "y"), have + step


def report(docs: DataFrame, length: int = 50) -> DataFrame:
    """doc_id, n_bytes, n_removed of each row."""
    held = cut(docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("doc", F.monotonically_increasing_id()), "rows")
    # Each start removes the bytes up to the next start, `length` at most.
    gone = F.aggregate("starts", F.struct(F.lit(-length).alias("last"), F.lit(0).cast("long").alias("sum")), lambda a, i: F.struct(i.alias("last"), (a["sum"] + F.least(F.lit(length), i - a["last"])).alias("sum")), lambda a: a["sum"])
    found = repeated(held, length).select("doc", gone.alias("n_removed"))
    return held.join(found, "doc", "left").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"))
