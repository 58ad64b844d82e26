"""Approximate nearest neighbours by cosine over robust-pruned directed graphs, one graph per shard.

Distinct vectors are dealt to shards of about SHARD by hash. In each shard points are inserted in seeded order, a batch at a time: greedy
beam searches from the medoid propose neighbours, and relaxed distance pruning keeps an edge to p only if no kept neighbour q has
ALPHA * d(q, p) <= d(., p), so edges stay diverse; reverse edges are added and pruned the same way. A second pass refines the graph. Queries travel in
blocks to every shard, a beam search there gives the shard's nearest, exact cosines in double precision order them, and
the best of all shards are kept.

Equal vectors are one graph node that holds the least vec_ids, so a vector that a third of the rows share is one node.

Defined cases: rows with a null vec_id, and vectors that are null, zero or hold null or non-finite components, take no part; a repeated vec_id
counts once, with the least of its vectors; vectors of another length are other spaces; ties go to the smaller vec_id; fewer candidates than k give fewer
rows; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nodetide.llm.common import cut

SHARD = 4096
DEGREE = 32
BUILD_BEAM = 48
BEAM = 96
ALPHA = 1.2
BATCH = 128
SEED = 7
QUERY_BLOCK = 2048


def usable(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id and v (array<double>), one row per vec_id."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = df.select(F.col(id_col).alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).filter(~bad)
    return good.filter(F.exists("v", lambda x: x != 0)).groupBy("vec_id").agg(F.min("v").alias("v"))


def beam_search(points: np.ndarray, graph: np.ndarray, start: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query (all unit vectors) the beam: ids and squared distances by distance (-1 and inf where there are fewer), and all points expanded.

    graph[i] are i's neighbours, -1 where there are fewer."""
    m, n = len(queries), len(points)
    ids = np.full((m, beam), -1)
    dist = np.full((m, beam), np.inf)
    ids[:, 0] = start
    dist[:, 0] = ((queries - points[start]) ** 2).sum(1)
    done = np.ones((m, beam), bool)
    done[:, 0] = False
    seen = np.zeros((m, n), bool)
    seen[:, start] = True
    expanded, live = [], np.arange(m)
    while len(live):
        pick = np.where(done[live], np.inf, dist[live]).argmin(1)
        open_ = ~done[live, pick]
        live, pick = live[open_], pick[open_]
        if not len(live):
            break
        at = ids[live, pick]
        done[live, pick] = True
        step = np.full(m, -1)
        step[live] = at
        expanded.append(step)
        near = graph[at]
        fresh = (near >= 0) & ~seen[live[:, None], near]
        rows = np.repeat(live, near.shape[1]).reshape(near.shape)
        seen[rows[fresh], near[fresh]] = True
        d = np.full(near.shape, np.inf)
        d[fresh] = 2 - 2 * np.einsum("ij,ij->i", queries[rows[fresh]], points[near[fresh]])
        all_d, all_i = np.concatenate((dist[live], d), 1), np.concatenate((ids[live], near), 1)
        all_done = np.concatenate((done[live], ~fresh), 1)
        order = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
        dist[live], ids[live], done[live] = (np.take_along_axis(x, order, 1) for x in (all_d, all_i, all_done))
    order = np.argsort(dist, axis=1, kind="stable")
    dist, ids = np.take_along_axis(dist, order, 1), np.take_along_axis(ids, order, 1)
    ids[np.isinf(dist)] = -1
    return ids, dist, np.array(expanded).T if expanded else np.full((m, 0), -1)


def prune(points: np.ndarray, i: int, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """The diverse neighbours of i among the candidates, nearest first."""
    candidates = np.unique(candidates)
    candidates = candidates[(candidates >= 0) & (candidates != i)]
    d = 2 - 2 * points[candidates] @ points[i]
    order = np.argsort(d, kind="stable")
    candidates, d = candidates[order], np.sqrt(np.maximum(d[order], 0))
    between = np.sqrt(np.maximum(2 - 2 * points[candidates] @ points[candidates].T, 0))
    out, alive = [], np.ones(len(candidates), bool)
    for k in range(len(candidates)):
        if alive[k]:
            out.append(k)
            if len(out) == degree:
                break
            alive &= alpha * between[k] > d
    return candidates[out]


def build(points: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, seed: int = SEED) -> tuple[np.ndarray, int]:
    """The graph (n, degree) over unit vectors, and the medoid to start from."""
    n = len(points)
    rng = np.random.default_rng(seed)
    graph = np.full((n, degree), -1)
    start = int((points @ points.mean(0)).argmax())
    if n == 1:
        return graph, start
    few = min(degree // 2, n - 1)
    steps = rng.choice(n - 1, few, replace=False) + 1  # to begin with, a random circulant graph
    graph[:, :few] = (np.arange(n)[:, None] + steps) % n
    for a in (1.0, alpha):
        order = rng.permutation(n)
        for lo in range(0, n, BATCH):
            batch = order[lo : lo + BATCH]
            ids, _, expanded = beam_search(points, graph, start, points[batch], beam)
            back: dict[int, list[int]] = {}
            for k, i in enumerate(batch.tolist()):
                kept = prune(points, i, np.concatenate((ids[k], expanded[k], graph[i])), degree, a)
                graph[i] = -1
                graph[i, : len(kept)] = kept
                for j in kept.tolist():
                    back.setdefault(j, []).append(i)
            for j, add in back.items():
                own = graph[j][graph[j] >= 0]
                add = [i for i in add if i not in own]
                if len(own) + len(add) <= degree:
                    graph[j, len(own) : len(own) + len(add)] = add
                else:
                    kept = prune(points, j, np.concatenate((own, add)), degree, a)
                    graph[j] = -1
                    graph[j, : len(kept)] = kept
    return graph, start


def _unit(v: np.ndarray) -> np.ndarray:
    scaled = v / np.abs(v).max(1, keepdims=True)  # no overflow, whatever the components' size
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def index(vectors: DataFrame, k: int) -> DataFrame:
    """One row per shard: shard, dim, n, vectors, ids (the k + 1 least of each distinct vector), sizes of ids, graph, start. Indexes every vector."""
    same = W.partitionBy("v").orderBy("vec_id")
    nodes = vectors.withColumn("r", F.row_number().over(same)).filter(F.col("r") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    nodes = cut(nodes.withColumn("dim", F.size("v")), "nodes")
    shards = max(1, -(-nodes.count() // SHARD))

    def make(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("first").reset_index(drop=True)
        raw = np.stack(group["v"].to_numpy()).astype(float)
        graph, start = build(_unit(raw))
        return pd.DataFrame([{
            "shard": int(group["shard"][0]), "dim": raw.shape[1], "vectors": raw.tobytes(), "ids": np.concatenate(group["ids"].to_list()).astype(np.int64).tobytes(),
            "sizes": group["ids"].map(len).to_numpy(np.int32).tobytes(), "graph": graph.astype(np.int32).tobytes(), "start": start,
        }])

    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int")).withColumn("first", F.element_at("ids", 1))
    return cut(dealt.groupBy("shard", "dim").applyInPandas(make, "shard int, dim int, vectors binary, ids binary, sizes binary, graph binary, start int"), "graphs")


def search(vectors: DataFrame, queries: DataFrame, k: int, beam: int = BEAM) -> DataFrame:
    """The k nearest found of each of `queries` (vec_id, v) among `vectors`: query_id, rank, vec_id, score. The query's own vec_id is no candidate."""
    graphs = index(vectors, k)
    queries = cut(queries.select("vec_id", "v", F.size("v").alias("dim")), "queries")
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    packed = queries.groupBy("dim", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("part")).agg(F.sort_array(F.collect_list(F.struct("vec_id", "v"))).alias("queries"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = points = graph = ids = None
        for b in batches:
            for r in range(b.num_rows):
                g = {c: b.column(c)[r].as_py() for c in ("shard", "dim", "start", "queries")}
                if (g["shard"], g["dim"]) != shard:  # rows come by shard
                    shard = g["shard"], g["dim"]
                    points = _unit(np.frombuffer(b.column("vectors")[r].as_py()).reshape(-1, g["dim"]))
                    graph = np.frombuffer(b.column("graph")[r].as_py(), np.int32).reshape(len(points), -1)
                    ends = np.cumsum(np.frombuffer(b.column("sizes")[r].as_py(), np.int32))
                    ids = np.split(np.frombuffer(b.column("ids")[r].as_py(), np.int64), ends[:-1])
                own = [q["vec_id"] for q in g["queries"]]
                q = _unit(np.array([q["v"] for q in g["queries"]], float))
                out: list[tuple[int, int, float]] = []
                for lo in range(0, len(q), BATCH):
                    found, _, _ = beam_search(points, graph, g["start"], q[lo : lo + BATCH], beam)
                    for i, row in enumerate(found[:, : 2 * (k + 1)], lo):
                        row = row[row >= 0]
                        score = points[row] @ q[i]
                        best = sorted((-s, x) for s, node in zip(score.tolist(), row.tolist(), strict=True) for x in ids[node].tolist() if x != own[i])
                        out += [(own[i], x, -s) for s, x in best[:k]]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.float64())], ["query_id", "vec_id", "score"])

    # A block's rows and one shard's graph meet in one row; the stated query set against all rows, in blocks.
    met = graphs.hint("merge").join(packed.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(max(0, (graphs.agg(F.max("shard")).first()[0] or 0)))))), ["shard", "dim"])
    found = met.select("shard", "dim", "vectors", "ids", "sizes", "graph", "start", "queries").mapInArrow(run, "query_id long, vec_id long, score double")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest_of_every_fiftieth(embeddings: DataFrame, k: int = 5) -> DataFrame:
    vectors = cut(usable(embeddings), "vectors")
    return search(vectors, vectors.filter(F.col("vec_id") % 50 == 0), k)


def exact(vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, k: int) -> dict[int, list[tuple[int, float]]]:
    """Brute force, to measure recall: for each query id its k nearest (vec_id, score)."""
    u = _unit(vectors)
    out = {}
    for q in queries.tolist():
        s = u @ u[int(np.flatnonzero(ids == q)[0])]
        keep = ids != q
        best = sorted(zip((-s[keep]).tolist(), ids[keep].tolist(), strict=True))[:k]
        out[q] = [(i, -s) for s, i in best]
    return out
