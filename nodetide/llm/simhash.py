"""SimHash near-duplicates with pigeonring filtering.

Fingerprints are 64-bit SimHashes of word shingles. Two fingerprints link at `distance` or fewer differing bits; documents are
classed by connected components.

Candidates come from a ring of five segments of the fingerprint. If two fingerprints differ in at most `distance` bits, some segment begins a
chain in which, for every length l, the first l segments differ in at most floor(l * distance / 5) bits together (the pigeonring principle).
For distance 2 that is 0, 0, 1, 1, 2: the first two segments of the chain are equal (a 25- or 26-bit key to group by) and each longer chain
prunes before the whole Hamming distance is taken.

Only distinct fingerprints are compared, so copies cost nothing, and a group gives a spanning forest of its links, never all pairs.
A group of more than SMALL_GROUP fingerprints is split along the ring: its next two segments differ in at most one bit together, so a pair
that the chain lets through agrees in one of them, and the group goes on as groups by either (38 or 39 equal bits). What is still too large is dealt into
cells of two blocks of at most SMALL_GROUP members, every two blocks meeting in one cell: no task holds a large group, and the same pairs link.

Defined cases: a null or blank text has no shingles and fingerprint zero, which links like any other; fewer words than a shingle
make one shingle of all of them; a null doc_id takes part and names a component only if nothing else does; repeated rows are in one component; an empty
table gives an empty result; only the id and the text are read, so other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nodetide.llm.common import cut

SEED = 42
SEGMENTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
DISTANCE = 2
SMALL_GROUP = 256


def majority(h) -> int:
    """The fingerprint of shingle hashes (array of unsigned): a bit is set if it is in over half of them."""
    import numpy as np

    total = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 14):
        total += np.unpackbits(h[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(h), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, shingle: int) -> int:
    """The unsigned fingerprint of one text."""
    import numpy as np
    from xxhash import xxh64_intdigest

    w = (text or "").encode("utf-8", "replace").lower().split()  # ASCII letters and ASCII white space only
    if not w:
        return 0
    joined = b" ".join(w)
    if len(w) <= shingle:
        return xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))
    n = len(w) - shingle + 1
    cuts = zip(begins[:n].tolist(), ends[shingle - 1 :].tolist(), strict=True)
    return majority(np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in cuts), np.uint64, n))


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a signed long)."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for b in batches:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in b.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, fp long")


def _segment(fp: Column, i: int) -> Column:
    at, n = SEGMENTS[i % 5]
    return F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << n) - 1))


def ring_keys(fp: Column) -> Column:
    """The five (k, key) of a fingerprint: two neighbouring segments of the ring that must be equal."""
    return F.array(*[F.struct(F.lit(k).alias("k"), F.shiftleft(_segment(fp, k), 13).bitwiseOR(_segment(fp, k + 1)).alias("key")) for k in range(5)])


def close(x, k: int):
    """Of differences x (unsigned), whether the chain from segment k stays within its budgets and the whole within DISTANCE."""
    import numpy as np

    near, spent = np.arange(len(x)), np.zeros(len(x), np.int64)
    for j in range(5):  # the chain grows; what is over its budget goes
        at, n = SEGMENTS[(k + j) % 5]
        spent = spent + np.bitwise_count(x[near] & np.uint64(((1 << n) - 1) << at))
        ok = spent <= DISTANCE * (j + 1) // 5
        near, spent = near[ok], spent[ok]
    out = np.zeros(len(x), bool)
    out[near[np.bitwise_count(x[near]) <= DISTANCE]] = True
    return out


def _forest(rows: pa.RecordBatch) -> tuple[list[int], list[int]]:
    """Links of each group (ring position k, list members of fp and block) that join two trees of its forest; of a cell of two blocks only pairs between them."""
    import numpy as np

    a, b = [], []
    for k, members in zip(rows.column("k").to_pylist(), rows.column("members"), strict=True):
        f, block = (members.values.field(c).to_numpy(zero_copy_only=False) for c in ("fp", "block"))
        f = f.view(np.uint64)
        mixed = len(f) and block.min() != block.max()
        # Breadth first: each member looks once at those that no tree has yet, so members that are all alike cost little.
        new = np.arange(len(f))
        while len(new) > 1:
            todo, new = [int(new[0])], new[1:]
            while todo and len(new):
                i = todo.pop()
                near = close(f[new] ^ f[i], k)
                if mixed:
                    near &= block[new] != block[i]
                hit = new[near]
                if len(hit):
                    a += [int(f[i].view(np.int64))] * len(hit)
                    b += f[hit].view(np.int64).tolist()
                    todo += hit.tolist()
                    new = new[~near]
    return a, b


def _next_segment(k: Column, step: int) -> Column:
    """The segment `step` places after k."""
    return F.get(F.array(*[_segment(F.col("fp"), i) for i in range(5)]), (k + step) % 5)


def links(fps: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) whose components are those of all links at DISTANCE or less."""
    keys = fps.select("fp", F.explode(ring_keys(F.col("fp"))).alias("x")).select("fp", F.col("x.k").alias("k"), F.col("x.key").cast("long").alias("key"))
    sizes = keys.groupBy("k", "key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = cut(keys.join(sizes, ["k", "key"]), "shared")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = _forest(batch)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def found(members: DataFrame, by: list[str]) -> DataFrame:
        packed = members.groupBy(*by).agg(F.collect_list(F.struct("fp", "block")).alias("members"))
        return packed.select("k", "members").mapInArrow(pairs, "a long, b long")

    one = F.lit(0).alias("block")
    out = found(shared.filter(F.col("n") <= SMALL_GROUP).select("k", "key", "fp", one), ["k", "key"])
    large = shared.filter(F.col("n") > SMALL_GROUP)
    if not large.limit(1).count():
        return out.distinct()
    sub = large.select("k", "key", "fp", F.explode(F.array(*[F.struct(F.lit(i).alias("at"), _next_segment(F.col("k"), i).alias("next")) for i in (2, 3)])).alias("x")).select("k", "key", "fp", "x.at", "x.next")
    by = ["k", "key", "at", "next"]
    sub = cut(sub.join(sub.groupBy(*by).agg(F.count("*").alias("n")).filter("n > 1"), by), "split")
    out = out.unionByName(found(sub.filter(F.col("n") <= SMALL_GROUP).select(*by, "fp", one), by))
    blocks = F.ceil(F.col("n") / SMALL_GROUP).cast("int")
    dealt = sub.filter(F.col("n") > SMALL_GROUP).select(*by, "fp", blocks.alias("blocks"), F.pmod(F.xxhash64("fp"), blocks).cast("int").alias("block"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = met.select(*by, F.least("block", "other").alias("c"), F.greatest("block", "other").alias("d"), "fp", "block")
    return out.unionByName(found(cells, [*by, "c", "d"])).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of edges(a, b) but the roots; root is the least node of the component.

    Large-star and small-star steps alternate until all edges lead straight to roots; each round is written to the shared folder."""
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "edges")
    while not _all_stars(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*").filter("u != v").distinct()
        e = cut(small, "edges")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _all_stars(e: DataFrame) -> bool:
    """Whether each u of the edges (u, v) has one v, which has none itself."""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("out")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("out")))
    wrong = ends.groupBy("x").agg(F.sum("out").alias("outs"), F.min("out").alias("least")).filter("outs > 1 OR (outs = 1 AND least = 0)")
    return not wrong.limit(1).count()


def near_duplicates(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id: one row per input row."""
    prints = cut(fingerprints(docs, shingle, id_col, text), "simhash")
    least = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "least")
    tree = components(links(least.select("fp")))
    tree = tree.unionByName(tree.select(F.col("root").alias("node"), "root").distinct())
    tree = cut(tree.join(least, F.col("node") == F.col("fp")).select("fp", "root", "least"), "tree")
    # Written before they are joined, so that Spark can split the rows of a large component, or of a text that many share.
    named = cut(tree.groupBy("root").agg(F.min("least").alias("component_id")), "components")
    placed = tree.join(named, "root").select("fp", "component_id", F.lit(True).alias("_linked"))
    held = cut(least.join(placed, "fp", "left").select("fp", F.when(F.col("_linked"), F.col("component_id")).otherwise(F.col("least")).alias("component_id")), "named")
    return prints.join(held, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
