"""Removal of long word sequences that an earlier document has, by super-k-mer partitioning.

A word goes if it lies in a window of LENGTH words whose sequence also starts in a document with a smaller doc_id. Each window has a
minimiser, the least-hashed K-gram of its words. Consecutive windows that share one form a super-k-mer and travel as
one packed string to the minimiser's bucket; equal windows always meet there, where sorting finds the least document of each
window exactly, and bits go back.

Before that, one round asks which minimisers more than one document has, so that strings of unshared ones stay at home. A block sends equal strings once, with its
least document. A minimiser that more than HOT blocks share would fill its bucket with strings; its windows get a second minimiser, the least K-gram by another hash, and travel as
super-k-mers of that to its bucket: equal windows agree in both. See `blockwise`.

Defined cases: a null or blank text has no words and nothing removed; a row without doc_id is neither cut nor a source; rows with equal doc_id aren't
sources for each other; repeated rows get the same result; an empty table gives an empty result; texts of any length are taken whole.
"""

from __future__ import annotations

import hashlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from nodetide.llm import blockwise as B

LENGTH = 50
K = 12
HOT = 512
_OTHER = 0xD6E8FEB86659FD93


def _ranks(words: list[bytes], length: int) -> bytes:
    """16 bytes for each window of `words`."""
    from xxhash import xxh3_128_digest

    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    begins = [0, *ends]
    return b"".join([xxh3_128_digest(joined[begins[i] : ends[i + length - 1] - 1]) for i in range(len(words) - length + 1)])


class _Block:
    def __init__(self, rows: pa.RecordBatch, got: dict, buckets: int, length: int, rounds: int):
        from xxhash import xxh3_64_intdigest

        self.buckets, self.length = buckets, length
        self.words = [(t or b"").split() for t in rows.column("text").cast(pa.binary()).to_pylist()]
        self.flat = [w for ws in self.words for w in ws]
        sizes = self.sizes = np.array([len(w) for w in self.words], np.int64)
        hashes = np.fromiter(map(xxh3_64_intdigest, self.flat), np.uint64, len(self.flat))
        ids = B.Ids(rows.column("doc_id"))
        self.a = a = B.Anchors(hashes, sizes, ids, K, length)
        if rounds < 1:
            return
        hot = B.by_bucket(a.key, got, 1, buckets, buckets)[a.of]
        shared = a.shared(got, buckets)[a.of]
        cold = np.flatnonzero(shared & ~hot)
        self.begin, self.end, self.id, key = a.begin[cold], a.end[cold], a.id[cold], a.key[a.of[cold]]
        if (split := np.flatnonzero(shared & hot)).size:
            starts = len(hashes) - length + 1
            edge = np.zeros(starts + 1, np.int64)
            np.add.at(edge, a.begin[split], 1)
            np.add.at(edge, a.end[split], -1)
            least = B.sliding_min(B.rolling(B.mix64(hashes ^ np.uint64(_OTHER)), K), length - K + 1)
            begin, end = B.runs(least, np.cumsum(edge[:-1]) > 0)
            self.begin, self.end = np.concatenate((self.begin, begin)), np.concatenate((self.end, end))
            self.id = np.concatenate((self.id, ids.value[a.doc_at(begin)]))
            key = np.concatenate((key, B.mix64(least[begin] ^ np.uint64(_OTHER))))
        # Super-k-mers of shared minimisers: each distinct string once, in the order of its minimiser.
        order = np.argsort(key, kind="stable")
        self.begin, self.end, self.id, key = self.begin[order], self.end[order], self.id[order], key[order]
        self.strings, self.place, owner, least_id = {}, np.zeros(len(key), np.int64), [], []
        for i, (x, y, d) in enumerate(zip(self.begin.tolist(), self.end.tolist(), self.id.tolist(), strict=True)):
            k = self.strings.setdefault(b" ".join(self.flat[x : y + length - 1]), len(self.strings))
            self.place[i] = k
            if k == len(least_id):
                least_id.append(d)
                owner.append(i)
            elif d < least_id[k]:
                least_id[k] = d
        self.least = np.array(least_id, np.int64)
        self.key = key[np.array(owner, np.int64)]

    def _string_bounds(self) -> np.ndarray:
        """Where each bucket's strings begin and end; they are in the order of their minimisers."""
        return B.split_buckets(self.key, self.buckets)[0]

    def ask(self) -> dict[int, bytes]:
        out, strings, bounds = {}, list(self.strings), self._string_bounds()
        for b in np.flatnonzero(np.diff(bounds)).tolist():
            i, j = int(bounds[b]), int(bounds[b + 1])
            raw = b"\n".join(strings[i:j])
            out[b] = (j - i).to_bytes(4, "little") + self.least[i:j].tobytes() + len(raw).to_bytes(4, "little") + pa.compress(raw, codec="zstd", asbytes=True)
        return out

    def removed(self, got: dict) -> np.ndarray:
        n = len(self.flat)
        marks = np.zeros(n, bool)
        # The windows of all strings in a row, and of each whether an earlier document elsewhere has it.
        runs = self.end - self.begin
        size = np.zeros(len(self.strings), np.int64)
        size[self.place] = runs
        first = np.cumsum(size) - size
        smaller = np.zeros(int(size.sum()), bool)
        bounds = self._string_bounds()
        ends = np.append(first, len(smaller))
        for b in np.flatnonzero(np.diff(bounds)).tolist():
            if data := got.get((2, b)):
                i, j = ends[bounds[b]], ends[bounds[b + 1]]
                smaller[i:j] = B.unbits(data, int(j - i))
        step = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
        at = np.repeat(self.begin, runs) + step
        # Strings of this block overlap in windows too: the answer weighs them with all others.
        later = np.repeat(self.id > self.least[self.place], runs)
        marks[at[smaller[np.repeat(first[self.place], runs) + step] | later]] = True
        return B.dilate(marks, self.length) if n else marks


def _reply_minimisers(asked: list[bytes], hot: int) -> tuple[list[bytes], list[bytes]]:
    """Bits: other blocks have it; and, after them, more than `hot` blocks have it."""
    keys = [B.expand(x)[0] for x in asked]
    n = B.holders(keys)
    return B.split_bits(n > 1, keys), B.split_bits(n > hot, keys)


def _reply_windows(asked: list[bytes], length: int) -> list[bytes]:
    """Strings: bits of all windows in order. Each window is sorted with every other of the bucket."""
    out = []
    for x in asked:
        n = int.from_bytes(x[:4], "little")
        doc = np.frombuffer(x, np.int64, n, 4)
        size = int.from_bytes(x[4 + 8 * n : 8 + 8 * n], "little")
        strings = pa.decompress(x[8 + 8 * n :], size, codec="zstd", asbytes=True).split(b"\n")
        ranks = [_ranks(s.split(b" "), length) for s in strings]
        r = np.frombuffer(b"".join(ranks), ">u8").astype(np.uint64).reshape(-1, 2)
        out.append([r[:, 0], r[:, 1], np.repeat(doc, [len(k) // 16 for k in ranks])])
    return B.reply_smaller(out)


def report(docs: DataFrame, length: int = LENGTH, block_bytes: int | None = None, hot: int = HOT) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of each row."""
    d = docs.select("doc_id", "text")
    blocks, n = B.pack(d, "text", block_bytes)
    block = lambda rows, got, rounds: _Block(rows, got, n, length, rounds)
    asked = B.questions(blocks, None, lambda r, g: block(r, g, 0).a.ask(n))
    first = B.answer(asked, 1, lambda q, bucket: _reply_minimisers(q, hot), n)
    asked = B.questions(blocks, first, lambda r, g: block(r, g, 1).ask())
    second = first.unionByName(B.answer(asked, 2, lambda q, bucket: _reply_windows(q, length)))

    def last(rows: pa.RecordBatch, got: dict) -> pa.RecordBatch:
        b = block(rows, got, 1)
        gone = b.removed(got)
        ends = np.cumsum(b.sizes)
        total = np.concatenate(([0], np.cumsum(gone)))
        sha = []
        for w, e in zip(b.words, ends.tolist(), strict=True):
            out = gone[e - len(w) : e]
            sha.append(hashlib.sha256(b" ".join([x for x, g in zip(w, out.tolist(), strict=True) if not g] if out.any() else w)).hexdigest())
        return pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(b.sizes, pa.int64()), pa.array(total[ends] - total[ends - b.sizes], pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return B.finish(blocks, second, last, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, n_words long, n_removed long, kept_sha256 string")
