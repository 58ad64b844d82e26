"""Quality scores by ridge regression on random Fourier features of document statistics, calibrated by isotonic regression.

Each whole text becomes a vector of statistics (once, in one pass over the texts). Random Fourier features z = cos(Wx + b) approximate a Gaussian kernel on
the standardised vector. Labelled rows are dealt anew by size, and each task sums its part of the normal equations Z'Z and Z'y; the sums are added up in two steps, and at most
eight matrices of a fixed size reach the driver. Part of the training rows is kept out of the fit: their scores are counted in BINS bins, and
pool-adjacent-violators on the bins gives the monotone map from score to probability. All labelled training rows are used.

Defined cases: null and empty texts have the statistics of an empty text and get a score like any other; a doc_id with several labels counts with their mean;
labels of unknown documents are ignored; without training labels of both kinds every score is 0.5; an empty table gives an empty result; labels, lang, source and
doc_id never enter a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nodetide.llm.common import cut

FEATURES = 256
RIDGE = 1e-4
BINS = 1000
SEED = 11
THRESHOLD = 0.3
#: Width of the Gaussian kernel in standard deviations, per square root of the number of statistics.
WIDTH = 1.0
STATISTICS = ("log_bytes", "log_words", "word_bytes", "symbols", "upper", "exclamations", "digits", "punctuation", "newlines", "wide", "distinct", "adjacent", "repeated_lines", "commonest", "long_words")


def _fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary"))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(_fold(doc_id) % 5 == 0, F.lit(False))


def statistics(text: bytes) -> list[float]:
    """Statistics of one UTF-8 text, in the order of STATISTICS."""
    n = len(text)
    words = text.split()
    m = len(words)
    if not m:
        return [float(np.log1p(n))] + [0.0] * (len(STATISTICS) - 1)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    some = lambda chars: float(counts[list(chars)].sum())
    lines = [x for x in text.split(b"\n") if x.strip()]
    kinds: dict[bytes, int] = {}
    for w in words:
        kinds[w] = kinds.get(w, 0) + 1
    lower, upper = float(counts[97:123].sum()), float(counts[65:91].sum())
    adjacent = sum(map(bytes.__eq__, words, words[1:]))
    return [
        float(np.log1p(n)), float(np.log1p(m)), (n - m) / m, some(b"#*$%&|<>") / m, upper / (1 + lower + upper), some(b"!?") / m, float(counts[48:58].sum()) / n,
        some(b".,;:'\"()-") / m, float(counts[10]) / m, float(counts[128:].sum()) / n, len(kinds) / m, adjacent / m,
        1 - len(set(lines)) / len(lines), max(kinds.values()) / m, sum(len(w) > 20 for w in words) / m,
    ]


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and x (array<double>) of each row, from whole texts."""
    d = docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [statistics(t.as_py() or b"") for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "x"])

    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, x array<double>")


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    b: np.ndarray
    beta: np.ndarray | None = None
    #: Calibration: raw scores (rising) and probabilities, between which it interpolates.
    at: np.ndarray | None = None
    value: np.ndarray | None = None

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.column_stack((np.cos(z @ self.w + self.b) * np.sqrt(2 / self.w.shape[1]), np.ones(len(x))))

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), 0.5) if self.at is None else np.clip(np.interp(self.raw(x), self.at, self.value), 0, 1)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), float).reshape(len(column), -1) if len(column) else np.zeros((0, len(STATISTICS)))


def normal_equations(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Z'Z and Z'y over rows (x, y), summed in each task, then in at most eight groups, then here. The rows are narrow and are dealt anew by size first: there are as many
    matrices as the labelled rows fill partitions, not as the table has."""
    d = model.w.shape[1] + 1

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        a, v, n = np.zeros((d, d)), np.zeros(d), 0
        for b in batches:
            n += b.num_rows
            z = model.features(_matrix(b.column("x")))
            a += z.T @ z
            v += z.T @ np.asarray(b.column("y"), float)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % 8], pa.int32()), pa.array([np.vstack((a, v)).tobytes()], pa.binary())], ["g", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((d + 1, d)), 0
        for b in batches:
            n += b.num_rows
            for s in b.column("sums"):
                total += np.frombuffer(s.as_py()).reshape(d + 1, d)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    sums = rows.hint("rebalance").mapInArrow(part, "g int, sums binary").repartition(8, "g").mapInArrow(add, "sums binary").collect()
    total = sum((np.frombuffer(bytes(r.sums)).reshape(d + 1, d) for r in sums), np.zeros((d + 1, d)))
    return total[:d], total[d]


def isotonic(at: np.ndarray, good: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over points in rising order, with n rows of which `good` are positive."""
    blocks: list[list[float]] = []
    for x, g, k in zip(at.tolist(), good.tolist(), n.tolist(), strict=True):
        blocks.append([g, k, x, x])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            g2, k2, _, hi = blocks.pop()
            blocks[-1] = [blocks[-1][0] + g2, blocks[-1][1] + k2, blocks[-1][2], hi]
    xs, ys = [], []
    for g, k, lo, hi in blocks:
        p = (g + 0.5) / (k + 1)  # no probability of exactly 0 or 1 from a finite sample
        xs += [lo, hi] if hi > lo else [lo]
        ys += [p] * (2 if hi > lo else 1)
    return np.array(xs), np.maximum.accumulate(np.array(ys))


def fit(labelled: DataFrame, features: int = FEATURES) -> Model:
    """A model from rows (x, y in [0, 1], calibrate boolean)."""
    k = len(STATISTICS)
    m = labelled.select(F.count("*"), *[f(F.get("x", F.lit(i))) for i in range(k) for f in (F.avg, F.stddev_pop)]).first()
    rng = np.random.default_rng(SEED)
    mean, scale = np.array([m[1 + 2 * i] or 0.0 for i in range(k)]), np.array([max(m[2 + 2 * i] or 0.0, 1e-3) for i in range(k)])
    model = Model(mean, scale, rng.normal(size=(k, features)) / (WIDTH * np.sqrt(k)), rng.uniform(0, 2 * np.pi, features))
    if not m[0]:
        return model
    a, v = normal_equations(labelled.filter(~F.col("calibrate")), model)
    n = max(a[-1, -1], 1.0)
    model.beta = np.linalg.solve(a / n + RIDGE * np.eye(len(a)), v / n)

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.round(np.clip(model.raw(_matrix(b.column("x"))), -1, 2) * BINS / 3).astype(np.int64)), b.column("y")], ["bin", "y"])

    bins = labelled.filter("calibrate").mapInArrow(raw, "bin long, y double").groupBy("bin").agg(F.sum("y").alias("good"), F.count("*").alias("n")).orderBy("bin").collect()
    if bins and 0 < sum(r.good for r in bins) < sum(r.n for r in bins):
        model.at, model.value = isotonic(np.array([r.bin for r in bins]) * 3 / BINS, np.array([r.good for r in bins]), np.array([r.n for r in bins]))
    return model


def score(stats: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of rows (doc_id, x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.score(_matrix(b.column("x")))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    kind = stats.schema["doc_id"].dataType.simpleString()
    return stats.select("doc_id", "x", held_out(F.col("doc_id")).alias("held_out")).mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Trains on the labelled rows that are not held out and scores all rows of `docs`."""
    stats = cut(document_statistics(docs), "statistics")
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.avg(F.col("quality").cast("double")).alias("y"))
    rows = stats.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).join(known, "doc_id").select("x", "y", (_fold(F.col("doc_id")) % 5 == 1).alias("calibrate"))
    return score(stats, fit(rows))
