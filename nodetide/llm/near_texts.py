"""Near-duplicate texts: classes that links make between texts whose sets of five-word shingles have a Jaccard similarity of LEAST or more.

Candidates come from two sides. SimHash: texts whose 64-bit fingerprints over the distinct shingles differ in at most two bits, found without loss by pigeonring (`simhash.links`).
That finds few appended or cut blocks: at a similarity of 0.8 two fingerprints differ in ten bits, which no ring of segments narrows down. So MinHash gives the rest:
BANDS keys of ROWS minima each; texts of similarity 0.8 share a key with probability 0.998, wherever their edits are.
A candidate pair whose fingerprints differ in more than FAR bits is dropped unseen: at similarity 0.8 that is five standard deviations away.

Every link is checked by the similarity of the two sets (32-bit hashes of the shingles). The members of a MinHash key are compared with its least member first, and of these each text with the closest
by fingerprint before the others, which are compared only if the classes don't join them already. The members of keys that then still hold several classes are dealt into blocks of BLOCK and compared within them,
which settles keys of no more members and joins most of a large group of near copies. Larger keys that still hold several classes are left to an exact join: sets are read in one order,
rare shingles first, and two similar sets must share one of the first that each lists (prefix and position filter). So texts that share a frame without being similar meet only by shingles that few hold.
What a shingle is counted by is a bucket of 2^BUCKET_BITS, over all sets; it decides the order only, not what is found.
A shingle that over 16 BLOCK listed sets share is dealt into cells of two blocks, so that no large group lands in one task.

Documents are packed into blocks (see `blockwise`), so their texts are never shuffled: what travels are keys, and the sets of texts that have a candidate.

Defined cases: texts are the same if their words are, in their order and in lower case; null and blank texts are the same text without words; fewer than five words make one shingle; each row is
classed by its text, so a repeated or null doc_id says nothing about its class; a class keeps the row of its least doc_id, or of any if none has one; of rows that are alike one stays; an empty table
gives an empty result; other columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodetide.llm import blockwise, simhash
from nodetide.llm.common import cut

SHINGLE = 5
LEAST = 0.8
BANDS = 16
ROWS = 5
FAR = 24
BLOCK = 64
BUCKET_BITS = 18


def shingle_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the SHINGLE-word shingles of a text in order; fewer words make one of all."""
    from xxhash import xxh64_intdigest

    w = (text or "").encode("utf-8", "replace").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    joined = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(w) - SHINGLE + 1)
    last = ends[min(SHINGLE, len(w)) - 1 :]
    return np.fromiter((xxh64_intdigest(joined[x:y], simhash.SEED) for x, y in zip(begins[:n].tolist(), last.tolist(), strict=True)), np.uint64, n)


def shingle_set(text: str | None) -> np.ndarray:
    """The sorted distinct 32-bit hashes of the shingles."""
    return np.unique((shingle_hashes(text) >> np.uint64(32)).astype(np.uint32))


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(simhash.SEED))
    return rng.integers(0, 1 << 63, (2, BANDS * ROWS), np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(h: np.ndarray) -> list[int]:
    """BANDS keys of a set of shingle hashes, each of ROWS minima; none of an empty set."""
    from xxhash import xxh3_64_intdigest

    if not len(h):
        return []
    h = np.unique(h)
    mul, add = _multipliers()
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(h), 2048):
        x = h[i : i + 2048, None] * mul + add
        least = np.minimum(least, ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)).min(0))
    return np.array([xxh3_64_intdigest(r.tobytes(), k) for k, r in enumerate(least.reshape(BANDS, ROWS))], np.uint64).view(np.int64).tolist()


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets have a Jaccard similarity of LEAST or more."""
    few, many = sorted((x, y), key=len)
    if len(few) < LEAST * len(many) or not len(few):
        return len(few) == len(many)
    at = np.minimum(np.searchsorted(many, few), len(many) - 1)
    both = int((many[at] == few).sum())
    return both >= LEAST * (len(x) + len(y) - both) - 1e-9


def prints(blocks: DataFrame, id_type: str) -> DataFrame:
    """A row for each document: block, row (its place there), doc_id, node (a hash of all words in their order), fp and bands (array<long>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("rows"), strict=True):
                rows = blockwise.unpack(data.as_py())
                node, fp, bands = [], [], []
                for t in rows.column("text"):
                    text = t.as_py()
                    h = shingle_hashes(text)
                    node.append(xxh3_64_intdigest(b" ".join((text or "").encode("utf-8", "replace").lower().split())))
                    fp.append(simhash.majority(np.unique(h)))
                    bands.append(band_keys(h))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block] * len(node), pa.int64()), pa.array(range(len(node)), pa.int32()), rows.column("doc_id"), pa.array(np.array(node, np.uint64).view(np.int64)), pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(bands, pa.list_(pa.int64()))],
                    ["block", "row", "doc_id", "node", "fp", "bands"],
                )

    return blocks.select("block", "rows").mapInArrow(run, f"block long, row int, doc_id {id_type}, node long, fp long, bands array<long>")


def _rows_of(blocks: DataFrame, wanted: DataFrame, run, schema: str) -> DataFrame:
    """run(rows of a block, its part of wanted(block, row, node)) for every block that has one."""
    own = wanted.groupBy("block").agg(F.collect_list(F.struct("row", "node")).alias("take"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, take in zip(batch.column("rows"), batch.column("take"), strict=True):
                yield run(blockwise.unpack(data.as_py()), take.values)

    return blocks.select("block", "rows").join(own.hint("shuffle_hash"), "block").select("rows", "take").mapInArrow(each, schema)


def _sets(blocks: DataFrame, places: DataFrame) -> DataFrame:
    """(node, s: the bytes of its shingle set) of places(block, row, node)."""

    def run(rows: pa.RecordBatch, take: pa.StructArray) -> pa.RecordBatch:
        texts = rows.column("text").take(take.field("row"))
        return pa.RecordBatch.from_arrays([take.field("node"), pa.array([shingle_set(t.as_py()).tobytes() for t in texts], pa.binary())], ["node", "s"])

    return cut(_rows_of(blocks, places, run, "node long, s binary"), "sets")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [similar(np.frombuffer(x.as_py(), np.uint32), np.frombuffer(y.as_py(), np.uint32)) for x, y in zip(b.column("x"), b.column("y"), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    both = pairs.select("a", "b").join(sets.select(F.col("node").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("y")), "b")
    return cut(both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "verified")


def _several(members: DataFrame, least: int = 2) -> DataFrame:
    """Those of members(key, node, root, fp) whose keys hold several roots and at least so many members, with n, their number."""
    keys = members.groupBy("key").agg(F.min("root").alias("u"), F.max("root").alias("v"), F.count("*").alias("n")).filter("u != v").filter(F.col("n") >= least).select("key", "n")
    return cut(members.join(cut(keys, "several"), "key"), "open")


def _block_links(open_: DataFrame, sets: DataFrame) -> DataFrame:
    """Similar pairs (a, b) of different roots within blocks of BLOCK members on average: all that keys of no more members need."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [x for m in b.column("members") for x in _links_among(m.as_py())]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["a", "b"])

    block = F.pmod(F.xxhash64("node", "key"), F.ceil(F.col("n") / BLOCK)).alias("block")
    dealt = open_.select("key", block, "node", "root", "fp").join(sets, "node")
    grouped = dealt.groupBy("key", "block").agg(F.collect_list(F.struct("node", "root", "fp", "s")).alias("members"))
    return cut(grouped.select("members").mapInArrow(run, "a long, b long").distinct(), "within")


def _links_among(members: list[dict]) -> list[tuple[int, int]]:
    """Similar pairs of the members that join two classes."""
    sets = [np.frombuffer(m["s"], np.uint32) for m in members]
    tree: dict[int, int] = {m["root"]: m["root"] for m in members}
    out = []

    def root(i: int) -> int:
        while tree[i] != i:
            tree[i] = tree[tree[i]]
            i = tree[i]
        return i

    for i, m in enumerate(members):
        for j in range(i):
            o = members[j]
            if ((m["fp"] ^ o["fp"]) & (1 << 64) - 1).bit_count() > FAR:
                continue
            p, q = root(m["root"]), root(o["root"])
            if p != q and similar(sets[i], sets[j]):
                tree[max(p, q)] = min(p, q)
                out.append((o["node"], m["node"]))
    return out


def common(x, y):
    """The least number of shingles that similar sets of sizes x and y have in common."""
    return np.ceil(LEAST / (1 + LEAST) * (x + y) - 1e-6)


def _frequencies(held: DataFrame) -> np.ndarray:
    """How many of the sets s hold a shingle of each bucket (its lowest bits), summed over all sets in slices."""
    size, slices = 1 << BUCKET_BITS, 64

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            held = np.frombuffer(b"".join(b.column("s").to_pylist()), np.uint32)
            total += np.bincount(held & np.uint32(size - 1), minlength=size)
        parts = [(i, x.tobytes()) for i, x in enumerate(total.reshape(slices, -1)) if x.any()]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in parts], pa.int32()), pa.array([x for _, x in parts], pa.binary())], ["slice", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums = [sum(np.frombuffer(x, np.int64) for x in many).tobytes() for many in b.column("n").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("slice"), pa.array(sums, pa.binary())], ["slice", "n"])

    out = np.zeros((slices, size // slices), np.int64)
    for r in held.select("s").mapInArrow(count, "slice int, n binary").groupBy("slice").agg(F.collect_list("n").alias("n")).mapInArrow(add, "slice int, n binary").collect():  # 64 rows of a fixed size
        out[r["slice"]] = np.frombuffer(r.n, np.int64)
    return out.reshape(-1)


def _first_shingles(held: DataFrame) -> DataFrame:
    """key (a shingle), node, root, fp, size (of the node's set), left (shingles of the set from this one on) for those shingles of held(node, root, fp, s) by which a similar set must be found.

    All sets are read in one order, rare buckets first. Sets that have c shingles in common have the first of them where each still has c left, so only shingles with enough left are listed;
    those alone in their bucket are in no other set."""
    seen = _frequencies(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, key, left = [], [], []
            sizes = []
            for i, s in enumerate(b.column("s").to_pylist()):
                x = np.frombuffer(s, np.uint32)
                n = seen[x & np.uint32(len(seen) - 1)]
                begin = np.lexsort((x, n))[: len(x) - int(np.ceil(LEAST * len(x) - 1e-6)) + 1]
                shared = n[begin] > 1
                row.append(np.full(int(shared.sum()), i))
                key.append(x[begin][shared])
                left.append((len(x) - np.arange(len(begin)))[shared])
                sizes.append(np.full(int(shared.sum()), len(x)))
            if not row:
                continue
            at = pa.array(np.concatenate(row))
            numbers = [pa.array(np.concatenate(v).astype(t)) for v, t in ((key, np.int64), (sizes, np.int32), (left, np.int32))]
            yield pa.RecordBatch.from_arrays([numbers[0], *(b.column(c).take(at) for c in ("node", "root", "fp")), *numbers[1:]], ["key", "node", "root", "fp", "size", "left"])

    return held.select("node", "root", "fp", "s").mapInArrow(run, "key long, node long, root long, fp long, size int, left int")


def _cells(members: DataFrame, most: int, *columns: str) -> DataFrame:
    """members(key, node, root, ...) dealt into cells, as key, kind, c, d, block and `columns`: all that pairs of different roots under a key need.

    The largest class of a key meets the other members only: in cells of kind 0, of a block of it (block -1 there) and a block of others. The others meet each
    other in cells of kind 1, of two of their blocks. A block has `most` members on average."""
    sizes = cut(members.groupBy("key", "root").agg(F.count("*").alias("n")), "sizes")
    keys = cut(sizes.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("most"), F.max("n").alias("large"), F.sum("n").alias("all"), F.count("*").alias("roots")).filter("roots > 1").select("key", "most", "large", (F.col("all") - F.col("large")).alias("rest")), "cells")
    blocks = lambda n: F.ceil(F.col(n) / most).cast("int")
    held = members.join(keys, "key").withColumns({"own": blocks("large"), "others": blocks("rest"), "chief": F.col("root") == F.col("most")})
    held = held.withColumn("at", F.pmod(F.xxhash64("node", "key"), F.when(F.col("chief"), F.col("own")).otherwise(F.col("others"))).cast("int"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    cell = lambda kind, c, d, block: F.struct(F.lit(kind).alias("kind"), c.alias("c"), d.alias("d"), block.alias("block"))
    at = F.col("at")
    chief = F.transform(upto("others"), lambda j: cell(0, at, j, F.lit(-1)))
    rest = F.concat(F.transform(upto("own"), lambda i: cell(0, i, at, at)), F.transform(upto("others"), lambda j: cell(1, F.least(at, j), F.greatest(at, j), at)))
    return held.withColumn("cell", F.explode(F.when(F.col("chief"), chief).otherwise(rest))).select("key", "cell.*", *columns)


def _first_links(open_: DataFrame, sets: DataFrame) -> DataFrame:
    """Similar pairs (a, b) of different roots among the nodes of open_(node, root, fp), found by a shingle that both must begin with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first, second = [], []
            for members in b.column("members"):
                node, root, fp, block, size, left = (members.values.field(c).to_numpy(zero_copy_only=False) for c in ("node", "root", "fp", "block", "size", "left"))
                mixed = block.min() != block.max()
                for i in range(0, len(node), 512):  # a part of the matrix at a time
                    part = slice(i, i + 512)
                    need = common(size[part, None], size[None, :])
                    ok = (left[part, None] >= need) & (left[None, :] >= need) & (root[part, None] < root[None, :])
                    ok &= np.bitwise_count((fp[part, None] ^ fp[None, :]).view(np.uint64)) <= FAR
                    if mixed:
                        ok &= block[part, None] != block[None, :]
                    x, y = np.nonzero(ok)
                    first += node[part][x].tolist()
                    second += node[y].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(first, pa.int64()), pa.array(second, pa.int64())], ["a", "b"])

    held = cut(open_.join(sets, "node"), "open-sets")
    listed = cut(_first_shingles(held), "first")
    by = ["key", "kind", "c", "d"]
    grouped = _cells(listed, 16 * BLOCK, "node", "root", "fp", "size", "left").groupBy(*by).agg(F.collect_list(F.struct("node", "root", "fp", "block", "size", "left")).alias("members"))
    pairs = grouped.select("members").mapInArrow(run, "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return _verified(cut(pairs.distinct(), "candidates"), sets)


def classes(blocks: DataFrame, id_type: str) -> tuple[DataFrame, DataFrame]:
    """The prints of the blocks, and (node, root) of the nodes that similarity links to others."""
    p = cut(prints(blocks, id_type), "prints")
    nodes = cut(p.groupBy("node").agg(F.min("fp").alias("fp"), F.min("bands").alias("bands"), F.min(F.struct("block", "row")).alias("at")), "nodes")
    keys = nodes.select("node", "fp", F.explode("bands").alias("key"))
    # Aggregates are written before they are joined, so that Spark can split a key that many texts share.
    least = cut(keys.groupBy("key").agg(F.min(F.struct("node", "fp")).alias("a"), F.count("*").alias("n")).filter("n > 1").select("key", "a"), "least")
    shared = cut(keys.join(least, "key"), "shared")
    bits = F.bit_count(F.col("fp").bitwiseXOR(F.col("a.fp")))
    stars = shared.filter("node != a.node").filter(bits <= FAR).select(F.col("a.node").alias("a"), F.col("node").alias("b"), bits.alias("bits"))
    by_fp = cut(nodes.groupBy("fp").agg(F.min("node").alias("a"), F.count("*").alias("n")), "fingerprints")
    equal = nodes.select("node", "fp").join(by_fp.filter("n > 1"), "fp").filter("node != a").select("a", F.col("node").alias("b"), F.lit(0).alias("bits"))
    close = simhash.links(by_fp.select("fp")).withColumnsRenamed({"a": "x", "b": "y"})
    close = close.join(by_fp.select(F.col("fp").alias("x"), F.col("a").alias("p")), "x").join(by_fp.select(F.col("fp").alias("y"), F.col("a").alias("q")), "y")
    close = close.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), F.lit(1).alias("bits"))
    pairs = cut(stars.unionByName(equal).unionByName(close).distinct(), "pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).unionByName(shared.select("node")).distinct()
    sets = _sets(blocks, nodes.join(wanted, "node").select("at.block", "at.row", "node"))
    # First each text with the candidate that is closest; then what is left between classes.
    best = pairs.groupBy("b").agg(F.min(F.struct("bits", "a")).alias("x")).select(F.col("x.a").alias("a"), "b")
    links = _verified(best, sets)
    # Where two steps along the closest candidates lead joins most classes; that it may not join all costs some checks, no link.
    step = links.select("b", "a")
    tree = step.join(step.select(F.col("b").alias("a"), F.col("a").alias("up")), "a", "left").select(F.col("b").alias("node"), F.coalesce("up", "a").alias("root"))
    other = _apart(pairs.select("a", "b").exceptAll(best), tree)
    links = links.unionByName(_verified(other, sets))
    tree = simhash.components(links)
    rooted = lambda members: members.select("key", "node", "fp").join(tree, "node", "left").select("key", "node", "fp", F.coalesce("root", "node").alias("root"))
    open_ = _several(rooted(shared))
    more = _block_links(open_, sets)
    if more.limit(1).count():
        links = links.unionByName(more)
        tree = simhash.components(links)
    open_ = _several(rooted(open_), BLOCK + 1)  # keys of fewer members are settled
    if open_.limit(1).count():
        more = _first_links(open_.select("node", "root", "fp").distinct(), sets)
        if more.limit(1).count():
            tree = simhash.components(links.unionByName(more))
    return p, tree


def _apart(pairs: DataFrame, tree: DataFrame) -> DataFrame:
    """The pairs (a, b) of different roots."""
    at = lambda c: tree.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    both = pairs.join(at("a"), "a", "left").join(at("b"), "b", "left")
    return both.filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")


def _classed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The blocks of `docs`, and (block, row, doc_id, root) of every row."""
    blocks, _ = blockwise.pack(docs)
    p, tree = classes(blocks, docs.schema["doc_id"].dataType.simpleString())
    return blocks, p.select("block", "row", "doc_id", "node").join(tree, "node", "left").select("block", "row", "doc_id", F.coalesce("root", "node").alias("root"))


def similar_documents(docs: DataFrame) -> DataFrame:
    """doc_id and component_id (the least doc_id of its class), one row per input row."""
    held = cut(_classed(docs.select("doc_id", "text"))[1], "classed")
    named = cut(held.groupBy("root").agg(F.min("doc_id").alias("component_id")), "named")
    return held.join(named, "root").select("doc_id", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of `docs` for each class, in their own columns: that of its least doc_id, or any if none has one."""
    blocks, held = _classed(docs)
    first = held.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "block", "row")).alias("k"))

    def run(rows: pa.RecordBatch, take: pa.StructArray) -> pa.RecordBatch:
        return rows.take(take.field("row").sort())

    schema = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return _rows_of(blocks, first.select("k.block", "k.row", F.col("root").alias("node")), run, schema)
