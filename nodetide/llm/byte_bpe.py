"""Byte-level BPE encoding and decoding through a sentencepiece BPE model made from a rank file.

The model is serialised straight from the vocabulary: every byte maps to one printable character, a token is the string
of its mapped bytes with score -rank, and normalisation is the identity. sentencepiece then merges the best-scored (lowest-rank)
pair first, leftmost on ties, which is the merge order of the rank file. Each match of the pre-token pattern is encoded by itself
(a match that is itself a token is that token), and decoding maps ids to pieces and characters back to bytes.

Defined cases: a null or empty text has no ids and decodes to no bytes; repeated rows repeat; an empty table gives an
empty result; texts of any length are encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodetide.llm.common import bound_batches

#: Pre-tokens that a worker remembers with their ids, in each of two generations; longer ones are encoded each time they come.
MEMORY = 150_000
LONG = 64
#: Bytes of text that a worker encodes at a time, one text at least.
SLICE_BYTES = 1 << 20


@lru_cache(2)
def byte_characters() -> list[str]:
    """One character for each byte: the byte itself where it prints and isn't a space, else one from U+0100 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in prints else chr(next(spare)) for b in range(256)]


def parse_ranks(raw: bytes) -> list[bytes]:
    """Token bytes by rank, from the bytes of a rank file."""
    pairs = [line.split() for line in raw.splitlines() if line.strip()]
    out = [b""] * (max(int(r) for _, r in pairs) + 1)
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, data: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(data)) + data


def _flag(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def serialise_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece ModelProto: piece 0 is the unknown piece, piece r + 1 the token of rank r."""
    import struct

    chars = byte_characters()
    piece = lambda s, score, kind: _field(1, _field(1, s.encode()) + b"\x15" + struct.pack("<f", score) + _flag(3, kind))
    pieces = [piece("<unk>", 0.0, 2)]
    pieces += [piece("".join(chars[b] for b in t), float(-r), 1) for r, t in enumerate(tokens)]
    trainer = _flag(3, 2) + _flag(4, len(pieces)) + _flag(40, 0) + _flag(41, (1 << 64) - 1) + _flag(42, (1 << 64) - 1) + _flag(43, (1 << 64) - 1)
    normalizer = _field(1, b"identity") + _flag(3, 0) + _flag(4, 0) + _flag(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normalizer)


class Codec:
    """Encodes and decodes in one process, by the bytes of a rank file."""

    def __init__(self, ranks: bytes, pattern: str):
        import regex
        import sentencepiece

        tokens = parse_ranks(ranks)
        self.rank = {t: r for r, t in enumerate(tokens)}
        self.split = regex.compile(pattern).findall
        self.model = sentencepiece.SentencePieceProcessor()
        self.model.LoadFromSerializedProto(serialise_model(tokens))
        self.table = {b: c for b, c in enumerate(byte_characters())}
        back = {c: b for b, c in self.table.items()}
        self.pieces = [bytes(back[c] for c in self.model.IdToPiece(i + 1)) for i in range(len(tokens))]
        self.piece_column = pa.array(self.pieces, pa.large_binary())
        self.name_column = pa.array([b"%d," % i for i in range(len(tokens))], pa.large_binary())
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        """The ids of pre-tokens, encoded in one call. Those that aren't long are remembered; the least recently learnt half of all goes when memory is full."""
        import numpy as np

        out: dict[str, bytes] = {}
        if len(self.known) + len(new) > MEMORY:
            self.before, self.known = self.known, {}
        ask = []
        for s in new:
            if (old := self.before.get(s)) is not None:
                out[s] = old
                continue
            raw = s.encode("utf-8", "replace")
            whole = self.rank.get(raw)
            if whole is None:
                ask.append((s, raw.decode("latin-1").translate(self.table)))
            else:
                out[s] = whole.to_bytes(4, "little")
        for (s, _), ids in zip(ask, self.model.EncodeAsIds([x for _, x in ask], num_threads=1) if ask else [], strict=True):
            out[s] = (np.array(ids, "<i4") - 1).tobytes()
        self.known.update((s, ids) for s, ids in out.items() if len(s) <= LONG)
        return out

    def forget(self) -> None:
        """Gives up what is remembered: a worker that waits for its next task, or takes up another stage, holds no more than the model."""
        self.known, self.before = {}, {}

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as packed little-endian 32-bit integers."""
        parts = [self.split(t or "") for t in texts]
        found = [list(map(self.known.get, p)) for p in parts]
        open_ = [i for i, f in enumerate(found) if None in f]
        if open_:
            learnt = self._learn(list(dict.fromkeys(s for i in open_ for s, f in zip(parts[i], found[i], strict=True) if f is None)))
            for i in open_:
                found[i] = [learnt[s] if f is None else f for s, f in zip(parts[i], found[i], strict=True)]
        return list(map(b"".join, found))

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]

    def digest_all(self, packed: list[bytes]) -> tuple[list[int], list[str], list[str]]:
        """Of each text's packed ids: how many, and the SHA-256 of their decimal numbers joined by commas and of the bytes that they decode to."""
        import numpy as np

        counts = [len(p) // 4 for p in packed]
        ids = pa.array(np.frombuffer(b"".join(packed), "<i4"))
        ends = np.cumsum([0, *counts])

        def digests(column: pa.Array, cut: int) -> list[str]:
            taken = column.take(ids)
            if not len(taken):
                return [hashlib.sha256().hexdigest()] * len(packed)
            offsets = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset : taken.offset + len(taken) + 1][ends].tolist()
            data = memoryview(taken.buffers()[2])
            return [hashlib.sha256(data[a : max(a, b - cut)]).hexdigest() for a, b in zip(offsets, offsets[1:])]

        return counts, digests(self.name_column, 1), digests(self.piece_column, 0)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


@lru_cache(2)
def codec(ranks: bytes, pattern: str) -> Codec:
    return Codec(ranks, pattern)


def rank_file(path: str) -> bytes:
    """The bytes of a rank file, read on the driver: they go to the workers with the plan, so no worker needs the file."""
    with open(path, "rb") as f:
        return f.read()


def _schema_with(df: DataFrame, *more: str) -> str:
    return ", ".join([f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema.fields] + list(more))


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", to: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """Adds `to`, the ids (array<int>) of `text`; keeps the columns named in `keep` (all, if None)."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != to]
    bound_batches(docs.sparkSession)
    d, ranks = docs.select(*dict.fromkeys([*keep, text])), rank_file(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks, pattern)
        for batch in batches:
            # A slice at a time bounds what a worker holds.
            for part in _slices(batch, text):
                packed = c.encode_all(part.column(text).to_pylist())
                offsets = pa.array([0, *_running(len(p) // 4 for p in packed)], pa.int32())
                values = pa.Array.from_buffers(pa.int32(), sum(map(len, packed)) // 4, [None, pa.py_buffer(b"".join(packed))])
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), pa.ListArray.from_arrays(offsets, values)], [*keep, to])
        c.forget()

    return d.mapInArrow(run, _schema_with(d.select(*keep), f"`{to}` array<int>"))


def decode(rows: DataFrame, path: str, pattern: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """Adds `to`, the bytes (binary) that the array `ids` stands for; null for null."""
    keep, ranks = [c for c in rows.columns if c != to], rank_file(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks, pattern)
        for batch in batches:
            out = [None if x is None else c.decode(x) for x in _lists(batch.column(ids))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(out, pa.binary())], [*keep, to])

    return rows.mapInArrow(run, _schema_with(rows.select(*keep), f"`{to}` binary"))


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: texts are encoded, and the ids alone decoded again, in one worker that holds one model."""
    bound_batches(docs.sparkSession)
    d, ranks = docs.select("doc_id", F.col("text").cast("string").alias("text")), rank_file(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks, pattern)
        for batch in batches:
            for b in _slices(batch, "text"):
                n, ids_sha, text_sha = c.digest_all(c.encode_all(b.column("text").to_pylist()))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        c.forget()

    return d.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _lists(column: pa.ListArray) -> Iterator[list[int] | None]:
    """The lists of a column one after the other, so that one at a time is a Python list."""
    values, offsets = column.values, column.offsets.to_pylist()
    for i, valid in enumerate(column.is_valid().to_pylist()):
        yield values.slice(offsets[i], offsets[i + 1] - offsets[i]).to_numpy(zero_copy_only=False).tolist() if valid else None


def _running(counts) -> Iterator[int]:
    total = 0
    for n in counts:
        total += n
        yield total


def _slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about `most` bytes of text each, one row at least."""
    begin, size = 0, 0
    col = batch.column(text)
    for i, t in enumerate(col):
        n = len(t.as_buffer() or b"") if t.is_valid else 0
        if i > begin and size + n > most:
            yield batch.slice(begin, i - begin)
            begin, size = i, 0
        size += n
    if batch.num_rows > begin:
        yield batch.slice(begin)
