"""Removal of long byte strings that an earlier document has, by distributed prefix doubling.

A byte of a document goes if it lies in a string of LENGTH bytes that also starts in a document with a smaller doc_id. Positions get ranks for growing
prefixes, and only positions whose rank is not unique to one document go on:

round 1   ranks of prefixes of LENGTH / 2 bytes. Every window of LENGTH bytes contains as many prefixes as it has minimisers to choose from, so it is
          enough to rank each window's minimiser: the least-hashed LENGTH / 2-byte string in it. Buckets sort the ranks; a window whose
          minimiser has a rank of its own occurs in no other document and is done.
round 2   runs of windows that share a minimiser (up to about LENGTH * 3 / 2 bytes) are ranked whole. A run that an earlier document has in whole is
          covered; if all documents extend the minimiser's rank alike, the rank is settled.
round 3   what is left, runs whose extensions differ, doubles to the full LENGTH: each window gets the rank of its LENGTH bytes and the buckets sort
          (rank, document). That is past the threshold, so nothing doubles again.

Ranks are hashes: 32 bits within a bucket in round 1 (a collision only keeps a position for the next round), 64 bits among runs that share a minimiser,
128 bits for windows. See `blockwise` for how blocks and buckets bound memory and skew.

Defined cases: a null or empty text has no bytes and nothing removed; a row without doc_id is neither cut nor a source; rows with equal doc_id
aren't sources for each other; repeated rows get the same result; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from nodetide.llm import blockwise as B

LENGTH = 50


def _bytes_of(rows: pa.RecordBatch, text: str) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a block's texts, and each text's size."""
    col = rows.column(text).cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(col) else np.zeros(0, np.uint8)
    return data, np.diff(offsets)


class _Block:
    """What a block knows after the answers it has."""

    def __init__(self, rows: pa.RecordBatch, got: dict, buckets: int, length: int, rounds: int, text: str, doc_id: str):
        from xxhash import xxh3_64_intdigest, xxh3_128_digest

        self.buckets, self.length = buckets, length
        self.data, self.sizes = _bytes_of(rows, text)
        table = B.mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        self.a = a = B.Anchors(table[self.data], self.sizes, B.Ids(rows.column(doc_id)), length // 2, length)
        if rounds < 1:
            return
        self.live = live = np.flatnonzero(a.shared(got, buckets)[a.of])
        raw = self.data.tobytes()
        cut = zip(a.begin[live].tolist(), (a.end[live] + length - 1).tolist(), strict=True)
        self.run_hash = np.fromiter((xxh3_64_intdigest(raw[i:j]) for i, j in cut), np.uint64, len(live))
        self.run_key, self.run_least, self.run_of = B.least_by(self.run_hash, a.id[live])
        # One entry for each live minimiser: its run's hash, and whether runs of this block differ.
        self.min_key, self.min_of = np.unique(a.key[a.of[live]], return_inverse=True)
        self.min_hash = np.zeros(len(self.min_key), np.uint64)
        self.min_hash[self.min_of] = self.run_hash
        self.min_differs = np.zeros(len(self.min_key), bool)
        np.logical_or.at(self.min_differs, self.min_of, self.min_hash[self.min_of] != self.run_hash)
        if rounds < 2:
            return
        open_key = B.by_bucket(self.min_key, got, 2, buckets)
        elsewhere = B.by_bucket(self.run_key, got, 2, buckets, buckets)
        self.covered = elsewhere[self.run_of] | (a.id[live] > self.run_least[self.run_of])
        look = live[~self.covered & (open_key | self.min_differs)[self.min_of]]
        counts = a.end[look] - a.begin[look]
        self.at = np.repeat(a.begin[look] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        self.at_id = np.repeat(a.id[look], counts)
        h = b"".join([xxh3_128_digest(raw[i : i + length]) for i in self.at.tolist()])
        rank = np.frombuffer(h, ">u8").astype(np.uint64).reshape(-1, 2)
        self.hi, self.lo, self.rank_least, self.rank_of = B.least_by_pair(rank[:, 0], rank[:, 1], self.at_id)

    def ask_runs(self) -> dict[int, bytes]:
        bounds, keys = B.split_buckets(self.min_key, self.buckets)
        out = {b: B.squeeze(keys[bounds[b] : bounds[b + 1]], self.min_hash[bounds[b] : bounds[b + 1]], self.min_differs[bounds[b] : bounds[b + 1]].view(np.uint8)) for b in np.flatnonzero(np.diff(bounds)).tolist()}
        bounds, _ = B.split_buckets(self.run_key, self.buckets)
        return out | {self.buckets + b: B.squeeze(self.run_key[bounds[b] : bounds[b + 1]], self.run_least[bounds[b] : bounds[b + 1]]) for b in np.flatnonzero(np.diff(bounds)).tolist()}

    def ask_windows(self) -> dict[int, bytes]:
        bounds, _ = B.split_buckets(self.hi, self.buckets)
        return {b: B.squeeze(self.hi[bounds[b] : bounds[b + 1]], self.lo[bounds[b] : bounds[b + 1]], self.rank_least[bounds[b] : bounds[b + 1]]) for b in np.flatnonzero(np.diff(bounds)).tolist()}

    def removed(self, got: dict) -> np.ndarray:
        """Whether each byte goes."""
        n = len(self.data)
        edge = np.zeros(n + 1, np.int32)
        done = self.live[self.covered]
        np.add.at(edge, self.a.begin[done], 1)
        np.add.at(edge, self.a.end[done], -1)
        marks = np.cumsum(edge[:n], dtype=np.int32) > 0
        smaller = B.by_bucket(self.hi, got, 3, self.buckets)
        marks[self.at[smaller[self.rank_of] | (self.at_id > self.rank_least[self.rank_of])]] = True
        return B.dilate(marks, self.length)


def _reply_runs(asked: list[bytes], bucket: int) -> list[bytes]:
    q = [B.expand(x) for x in asked]
    if len(q[0]) == 2:  # runs by hash
        return B.reply_smaller(q)
    key, of = np.unique(np.concatenate([x[0] for x in q]), return_inverse=True)
    every = np.concatenate([x[1] for x in q])
    one = np.zeros(len(key), np.uint64)
    one[of] = every
    differs = np.zeros(len(key), bool)
    np.logical_or.at(differs, of, (one[of] != every) | np.concatenate([x[2] for x in q]).astype(bool))
    return [B.bits(x) for x in np.split(differs[of], np.cumsum([len(x[0]) for x in q])[:-1])]


def _scan(docs: DataFrame, length: int, text: str, doc_id: str, last, schema: str, block_bytes: int | None) -> DataFrame:
    if length % 2:
        raise ValueError("length must be even")
    blocks, n = B.pack(docs, text, block_bytes)
    block = lambda rows, got, rounds: _Block(rows, got, n, length, rounds, text, doc_id)
    first = B.answer(B.questions(blocks, None, lambda r, g: block(r, g, 0).a.ask(n)), 1, B.reply_shared)
    second = first.unionByName(B.answer(B.questions(blocks, first, lambda r, g: block(r, g, 1).ask_runs()), 2, _reply_runs))
    third = second.unionByName(B.answer(B.questions(blocks, second, lambda r, g: block(r, g, 2).ask_windows()), 3, lambda q, bucket: B.reply_smaller([B.expand(x) for x in q])))

    def finish(rows, got):
        b = block(rows, got, 2)
        return last(rows, b, b.removed(got))

    return B.finish(blocks, third, finish, schema)


def report(docs: DataFrame, length: int = LENGTH, block_bytes: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row."""

    def last(rows: pa.RecordBatch, b: _Block, gone: np.ndarray) -> pa.RecordBatch:
        ends = np.cumsum(b.sizes)
        begins = ends - b.sizes
        total = np.concatenate(([0], np.cumsum(gone)))
        opens = gone.copy()
        opens[1:] &= ~gone[:-1]
        first = begins[b.sizes > 0]  # a run that ends a document goes on in no other
        opens[first] = gone[first]
        spans = np.concatenate(([0], np.cumsum(opens)))
        sha = [hashlib.sha256(b.data[i:j][~gone[i:j]].tobytes()).hexdigest() for i, j in zip(begins.tolist(), ends.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(b.sizes, pa.int64()), pa.array(total[ends] - total[begins], pa.int64()), pa.array(spans[ends] - spans[begins], pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    d = docs.select("doc_id", "text")
    return _scan(d, length, "text", "doc_id", last, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string", block_bytes)


def cut_texts(docs: DataFrame, length: int = LENGTH, block_bytes: int | None = None) -> DataFrame:
    """`docs` with the removed bytes cut from `text`. A character goes if all its bytes go, so that texts stay valid; null texts stay null."""

    def last(rows: pa.RecordBatch, b: _Block, gone: np.ndarray) -> pa.RecordBatch:
        if gone.any():
            starts = np.flatnonzero((b.data & 0xC0) != 0x80)
            whole = np.minimum.reduceat(gone, starts)
            gone = np.repeat(whole, np.diff(np.append(starts, len(gone))))
        ends = np.cumsum(b.sizes)
        kept = [b.data[j - n : j][~gone[j - n : j]].tobytes().decode("utf-8", "replace") for j, n in zip(ends.tolist(), b.sizes.tolist(), strict=True)]
        null = rows.column("text").is_null().to_pylist()
        text = pa.array([None if x else k for x, k in zip(null, kept, strict=True)], pa.string())
        at = rows.schema.get_field_index("text")
        return pa.RecordBatch.from_arrays([text if i == at else c for i, c in enumerate(rows.columns)], rows.schema.names)

    schema = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return _scan(docs, length, "text", "doc_id", last, schema, block_bytes)
