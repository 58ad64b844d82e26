"""Rounds of question and answer between blocks of documents and buckets of keys.

Documents are packed once into blocks of a few MB (compressed Arrow rows in a table in the shared folder, bucketed by block). In each round every
block derives questions from its texts and the answers it has so far; a question is a packed array of keys for one bucket. Each
bucket sorts the keys of all blocks together and answers each block with bits, in the order asked. A block asks about a key once,
however often it holds it, so a key that fills a third of the corpus reaches its bucket once per block and no task ever
holds a group of documents. The number of buckets follows the number of bytes. Texts are never shuffled: answers go to where the
table has their block. The answers of each round are written to the shared folder, so a lost executor costs one round's tasks at most.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodetide.llm.common import cut, new_folder

#: Bytes of text in a block, and bytes of text for each bucket.
BLOCK_BYTES = 2 << 20
BUCKET_BYTES = 16 << 20
#: Units that hashes and minimisers are taken of at a time.
PIECE = 1 << 15
LEAST_BUCKETS = 256
_QUESTION = "block long, bucket int, data binary"
_ANSWER = "block long, round int, bucket int, data binary"


def pack(docs: DataFrame, text: str = "text", block_bytes: int | None = None) -> tuple[DataFrame, int]:
    """A table of blocks (block, size, rows) holding every column of `docs`, and the number of buckets to use."""
    limit = block_bytes or BLOCK_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 32
        held, size, made = [], 0, 0

        def out():
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                for part in held:
                    w.write_batch(part)
            return pa.RecordBatch.from_arrays([pa.array([first + made], pa.int64()), pa.array([size], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "size", "rows"])

        for batch in batches:
            lengths = [len(t.as_buffer()) if t.is_valid else 0 for t in batch.column(text)]
            begin = 0
            for i, n in enumerate(lengths):
                if size and size + n > limit:
                    if i > begin:
                        held.append(batch.slice(begin, i - begin))
                    yield out()
                    held, size, made, begin = [], 0, made + 1, i
                size += n
            if len(lengths) > begin:
                # A slice keeps only its own rows once it is written; copying it frees the rest of the batch.
                held.append(pa.concat_batches([batch.slice(begin)]))
        if held:
            yield out()

    blocks = _bucketed(docs.mapInArrow(run, "block long, size long, rows binary"))
    total = blocks.agg(F.sum("size")).first()[0] or 0
    n = LEAST_BUCKETS
    while n * BUCKET_BYTES < total:
        n *= 2
    return blocks, n


def _bucketed(blocks: DataFrame) -> DataFrame:
    """`blocks` written to the shared folder and read back as buckets by block, which joins need not shuffle."""
    spark = blocks.sparkSession
    path = new_folder(spark, "blocks")
    name = path.rsplit("/", 1)[1].replace("-", "_")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks.write.option("compression", "none").option("path", path).bucketBy(n, "block").saveAsTable(name, format="parquet")
    out = spark.table(name)
    out.schema  # resolved: the files are known, and the catalog's entry isn't needed any more
    spark.sql(f"DROP TABLE {name}")
    return out


def unpack(data: bytes) -> pa.RecordBatch:
    table = pa.ipc.open_stream(data).read_all().combine_chunks()
    return table.to_batches()[0] if table.num_rows else pa.RecordBatch.from_pylist([], schema=table.schema)


def squeeze(*columns: np.ndarray) -> bytes:
    """Columns of equal length, byte planes first, compressed. The first must be sorted and is stored as differences."""
    n = len(columns[0])
    parts = [n.to_bytes(4, "little"), len(columns).to_bytes(1, "little")]
    for k, c in enumerate(columns):
        if k == 0 and n:
            c = np.concatenate((c[:1], np.diff(c)))
        parts += [c.dtype.str.encode().ljust(4), c.view(np.uint8).reshape(n, c.dtype.itemsize).T.tobytes()]
    raw = b"".join(parts)
    return len(raw).to_bytes(4, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def expand(data: bytes) -> list[np.ndarray]:
    raw = pa.decompress(data[4:], int.from_bytes(data[:4], "little"), codec="zstd", asbytes=True)
    n, count, at, out = int.from_bytes(raw[:4], "little"), raw[4], 5, []
    for k in range(count):
        t = np.dtype(raw[at : at + 4].decode().strip())
        c = np.frombuffer(raw, np.uint8, n * t.itemsize, at + 4).reshape(t.itemsize, n).T.copy().view(t).reshape(n)
        out.append(np.cumsum(c, dtype=t) if k == 0 else c)
        at += 4 + n * t.itemsize
    return out


def split_buckets(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket (top bits) of sorted 64-bit keys: bounds of each bucket's keys, and keys within the bucket (next 32 bits)."""
    bits = buckets.bit_length() - 1
    bounds = np.searchsorted(keys >> np.uint64(64 - bits), np.arange(buckets + 1, dtype=np.uint64))
    return bounds, (keys >> np.uint64(32 - bits)).astype(np.uint32)


Ask = Callable[[pa.RecordBatch, dict], dict[int, bytes]]


def questions(blocks: DataFrame, answers: DataFrame | None, ask: Ask) -> DataFrame:
    """Runs ask(rows, answers so far) on every block; it returns a question for each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows, got in _each(batches):
            q = ask(rows, got)
            if q:
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(q), pa.int64()), pa.array(list(q), pa.int32()), pa.array(list(q.values()), pa.binary())], ["block", "bucket", "data"])

    return _with(blocks, answers).mapInArrow(run, _QUESTION)


def finish(blocks: DataFrame, answers: DataFrame | None, last: Callable[[pa.RecordBatch, dict], pa.RecordBatch], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows, got in _each(batches):
            yield last(rows, got)

    return _with(blocks, answers).mapInArrow(run, schema)


def _with(blocks: DataFrame, answers: DataFrame | None) -> DataFrame:
    """Blocks with the list of their answers, which is no longer than what the block asked."""
    if answers is None:
        return blocks.select("block", "rows", F.lit(None).cast("array<struct<round:int,bucket:int,data:binary>>").alias("got"))
    own = answers.groupBy("block").agg(F.collect_list(F.struct("round", "bucket", "data")).alias("got"))
    return blocks.join(own.hint("shuffle_hash"), "block", "left").select("block", "rows", "got")


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, dict]]:
    for batch in batches:
        for i in range(batch.num_rows):
            got = {(x["round"], x["bucket"]): x["data"] for x in batch.column("got")[i].as_py() or []}
            yield batch.column("block")[i].as_py(), unpack(batch.column("rows")[i].as_py()), got


def answer(asked: DataFrame, number: int, reply: Callable[[list[bytes], int], list[bytes] | tuple], buckets: int = 0) -> DataFrame:
    """Answers of round `number`: reply(questions of one bucket, bucket) gives as many answers; empty ones aren't sent.

    A tuple of such lists is sent as answers of this bucket, of this plus `buckets`, and so on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blocks, held = None, [], []

        def out():
            replies = reply(held, now)
            replies = replies if isinstance(replies, tuple) else (replies,)
            found = [(b, now + buckets * k, a) for k, each in enumerate(replies) for b, a in zip(blocks, each, strict=True) if a]
            return pa.RecordBatch.from_arrays([pa.array([b for b, _, _ in found], pa.int64()), pa.array([number] * len(found), pa.int32()), pa.array([k for _, k, _ in found], pa.int32()), pa.array([a for _, _, a in found], pa.binary())], ["block", "round", "bucket", "data"])

        for batch in batches:
            for block, bucket, data in zip(*(batch.column(c).to_pylist() for c in ("block", "bucket", "data")), strict=True):
                if bucket != now:
                    if held:
                        yield out()
                    now, blocks, held = bucket, [], []
                blocks.append(block)
                held.append(data)
        if held:
            yield out()

    return cut(asked.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, _ANSWER), "answers")


def bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes() if flags.any() else b""


def unbits(data: bytes | None, n: int) -> np.ndarray:
    return np.zeros(n, bool) if not data else np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_MULT = 0x9E3779B97F4A7C15


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k values from each place on (polynomial, by doubling); len(h) - k + 1 of them."""
    out, have = None, 0
    step, length, p = h, 1, _MULT
    while True:
        if k & length:
            if out is None:
                out, have = step, length
            else:  # what is had so far, then `length` more
                n = len(h) - (have + length) + 1
                out = out[:n] * np.uint64(p) + step[have : have + n]
                have += length
        if 2 * length > k:
            break
        n = len(step) - length
        step = step[:n] * np.uint64(p) + step[length : length + n]
        length, p = 2 * length, p * p & (1 << 64) - 1
    return mix64(out)


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of the w values from each place on."""
    have = 1
    while 2 * have <= w:
        h = np.minimum(h[:-have], h[have:])
        have *= 2
    return np.minimum(h[: len(h) - (w - have)], h[w - have :]) if w > have else h


def runs(least: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end (exclusive) of the runs of valid window starts that share a minimiser."""
    n = len(valid)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.empty(n, bool)
    new[0] = True
    new[1:] = (least[1:] != least[:-1]) | ~valid[:-1]
    begins = np.flatnonzero(new & valid)
    stop = np.empty(n, bool)
    stop[-1] = True
    stop[:-1] = new[1:] | ~valid[1:]
    return begins, np.flatnonzero(stop & valid) + 1


def dilate(marks: np.ndarray, length: int) -> np.ndarray:
    """Whether each unit lies in a window of `length` units whose start is marked; windows end within the units."""
    at = np.flatnonzero(marks)
    edge = np.zeros(len(marks) + 1, np.int32)
    edge[at] = 1
    edge[at + length] -= 1
    return np.cumsum(edge[:-1], dtype=np.int32) > 0


class Ids:
    """doc_ids of a block: values, and which of them are null."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.int64())
        self.null = np.asarray(column.is_null())
        self.value = np.asarray(column.fill_null(0), np.int64)


class Anchors:
    """Runs of windows of a block that share a minimiser, from the hashes of all units and the units in each document.

    A window is `length` units of one document; its minimiser is the least hash of its k-grams. Rows without an id have none.
    `key` holds the distinct minimisers, sorted; `of` tells each run's place there."""

    def __init__(self, hashes: np.ndarray, sizes: np.ndarray, ids: Ids, k: int, length: int):
        n = len(hashes)
        self.ends = np.cumsum(sizes)
        starts = max(0, n - length + 1)
        least, valid = np.zeros(starts, np.uint64), np.ones(starts, bool)
        for lo in range(0, starts, PIECE):  # a piece at a time stays in the processor's cache
            part = hashes[lo : min(starts, lo + PIECE) + length - 1]
            least[lo : lo + PIECE] = sliding_min(rolling(part, k), length - k + 1)
        for first, end, null in zip((self.ends - sizes).tolist(), self.ends.tolist(), ids.null.tolist(), strict=True):
            valid[first if null else max(first, end - length + 1) : end] = False
        self.begin, self.end = runs(least, valid)
        self.doc = self.doc_at(self.begin)
        self.id = ids.value[self.doc]
        # Least hashes are small numbers; mixed anew they fall into all buckets alike.
        self.key, self.of = np.unique(mix64(least[self.begin] + np.uint64(_MULT)), return_inverse=True)
        low, high = np.full(len(self.key), np.iinfo(np.int64).max), np.full(len(self.key), -1)
        np.minimum.at(low, self.of, self.doc)
        np.maximum.at(high, self.of, self.doc)
        self.several = low != high

    def doc_at(self, unit: np.ndarray) -> np.ndarray:
        """The document that each unit is of."""
        return np.searchsorted(self.ends, unit, side="right")

    def ask(self, buckets: int) -> dict[int, bytes]:
        """Which minimisers do other blocks hold?"""
        bounds, keys = split_buckets(self.key, buckets)
        return {b: squeeze(keys[bounds[b] : bounds[b + 1]]) for b in np.flatnonzero(np.diff(bounds)).tolist()}

    def shared(self, got: dict, buckets: int, number: int = 1) -> np.ndarray:
        """Of each minimiser, whether more than one document holds it (never wrongly false)."""
        return self.several | by_bucket(self.key, got, number, buckets)


def by_bucket(keys: np.ndarray, got: dict, number: int, buckets: int, base: int = 0) -> np.ndarray:
    """The answers' bits in the order of the sorted keys."""
    out = np.zeros(len(keys), bool)
    bounds, _ = split_buckets(keys, buckets)
    for b in np.flatnonzero(np.diff(bounds)).tolist():
        if data := got.get((number, base + b)):
            out[bounds[b] : bounds[b + 1]] = unbits(data, bounds[b + 1] - bounds[b])
    return out


def reply_shared(asked: list[bytes], bucket: int = 0) -> list[bytes]:
    """Bits of the keys that more than one question holds."""
    keys = [expand(x)[0] for x in asked]
    return split_bits(holders(keys) > 1, keys)


def holders(keys: list[np.ndarray]) -> np.ndarray:
    """Of each entry of all arrays (each without repeats) in a row, how many arrays hold it."""
    every = np.concatenate(keys)
    order = np.argsort(every, kind="stable")
    sorted_ = every[order]
    new = np.flatnonzero(np.concatenate(([True], sorted_[1:] != sorted_[:-1])))
    sizes = np.diff(np.append(new, len(every)))
    out = np.empty(len(every), np.int64)
    out[order] = np.repeat(sizes, sizes)
    return out


def split_bits(flags: np.ndarray, keys: list[np.ndarray]) -> list[bytes]:
    return [bits(x) for x in np.split(flags, np.cumsum([len(k) for k in keys])[:-1])]


def least_by(keys: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys (sorted), the least value of each, and each entry's place among them."""
    distinct, of = np.unique(keys, return_inverse=True)
    low = np.full(len(distinct), np.iinfo(np.int64).max)
    np.minimum.at(low, of, value)
    return distinct, low, of


def least_by_pair(hi: np.ndarray, lo: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same for keys of two parts: distinct hi and lo, sorted, least values, and places."""
    order = np.lexsort((lo, hi))
    h, l = hi[order], lo[order]  # noqa: E741
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (l[1:] != l[:-1])
    at = np.flatnonzero(new)
    of = np.empty(len(h), np.int64)
    of[order] = np.cumsum(new) - 1
    low = np.minimum.reduceat(value[order], at) if len(at) else np.zeros(0, np.int64)
    return h[at], l[at], low, of


def reply_smaller(asked: list[list[np.ndarray]]) -> list[bytes]:
    """Questions (key, ..., doc): bits of the entries whose key has a smaller doc in some question. All columns but the last are the key."""
    sizes = [len(x[0]) for x in asked]
    columns = [np.concatenate(c) for c in zip(*asked, strict=True)]
    key, doc = columns[:-1], columns[-1]
    if not len(doc):
        return [b"" for _ in asked]
    order = np.lexsort((doc, *key[::-1]))
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([c[order][1:] != c[order][:-1] for c in key])
    first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    smaller = np.empty(len(order), bool)
    smaller[order] = doc[order][first] < doc[order]
    return [bits(x) for x in np.split(smaller, np.cumsum(sizes)[:-1])]
