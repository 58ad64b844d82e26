"""NIfTI-1 images as a Spark data source, with NumPy only.

`spark.read.format("nifti").load(paths)` gives one row per volume: path, t, v (array<float> in C order of (i, j, k)), in batches of CHUNK volumes. A compressed
file is one partition, read once from its start to its end; any other is one partition for each GROUP of volumes. `node_means` reduces volumes to
node means where they are read, so voxels never become rows. Files are read with Spark's own file access where a session is at hand (`binaryFile`), else from
the shared file system that all executors mount.
"""

from __future__ import annotations

import gzip
import io
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

CHUNK = 64
GROUP = 1024
MEMBERSHIP_ROWS = 20_000_000
# NIfTI-1 data type codes.
KINDS = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}
CODES = {v: k for k, v in KINDS.items()}


@dataclass(frozen=True)
class Header:
    shape: tuple[int, ...]
    kind: str
    offset: int
    slope: float
    inter: float
    affine: tuple[tuple[float, ...], ...]
    tr: float


def parse_header(raw: bytes) -> Header:
    order = "<" if struct.unpack("<i", raw[:4])[0] == 348 else ">"
    if struct.unpack(f"{order}i", raw[:4])[0] != 348:
        raise ValueError("not a NIfTI-1 header")
    dim = struct.unpack(f"{order}8h", raw[40:56])
    code = struct.unpack(f"{order}h", raw[70:72])[0]
    if code not in KINDS:
        raise ValueError(f"data type {code} isn't supported")
    pix = struct.unpack(f"{order}8f", raw[76:108])
    offset, slope, inter = struct.unpack(f"{order}3f", raw[108:120])
    if struct.unpack(f"{order}h", raw[254:256])[0] > 0:
        affine = np.array(struct.unpack(f"{order}12f", raw[280:328])).reshape(3, 4)
    else:
        affine = np.column_stack((np.diag(pix[1:4]), np.zeros(3)))
    affine = tuple(map(tuple, np.vstack((affine, [0, 0, 0, 1])).tolist()))
    return Header(tuple(dim[1 : dim[0] + 1]), order + KINDS[code], int(offset), slope or 1.0, inter if slope else 0.0, affine, pix[4])


def _open(path: str):
    return gzip.open(path, "rb") if path.endswith(".gz") else open(path, "rb")


def read_volumes(stream, header: Header, begin: int, end: int) -> Iterator[np.ndarray]:
    """Volumes [begin, end) of a 4D image as float32 arrays of shape (i, j, k)."""
    if len(header.shape) != 4:
        raise ValueError(f"expected a 4D image, not {len(header.shape)}D")
    count = int(np.prod(header.shape[:3]))
    size = count * np.dtype(header.kind).itemsize
    stream.seek(header.offset + begin * size)
    for _ in range(begin, end):
        v = np.frombuffer(stream.read(size), header.kind, count).reshape(header.shape[:3], order="F")
        yield (v * np.float32(header.slope) + np.float32(header.inter)).astype(np.float32)


def decode(raw: bytes) -> tuple[Header, np.ndarray]:
    """A whole image from the bytes of a file, compressed or not."""
    raw = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
    h = parse_header(raw[:352])
    data = np.frombuffer(raw, h.kind, int(np.prod(h.shape)), h.offset).reshape(h.shape, order="F")
    return h, data * h.slope + h.inter if (h.slope, h.inter) != (1.0, 0.0) else data


def encode(data: np.ndarray, affine, tr: float = 1.0) -> bytes:
    """The bytes of an uncompressed NIfTI-1 file."""
    kind = data.dtype.str[1:]
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, data.ndim, *data.shape, *[1] * (7 - data.ndim))
    struct.pack_into("<2h", head, 70, CODES[kind], data.dtype.itemsize * 8)
    struct.pack_into("<8f", head, 76, 1.0, *np.sqrt((np.array(affine)[:3, :3] ** 2).sum(0)).tolist(), tr, 0, 0, 0)
    struct.pack_into("<3f", head, 108, 352.0, 1.0, 0.0)
    struct.pack_into("<2h", head, 252, 0, 1)
    struct.pack_into("<12f", head, 280, *np.array(affine, float)[:3].ravel().tolist())
    head[344:348] = b"n+1\0"
    return bytes(head) + data.astype(data.dtype.newbyteorder("<")).tobytes(order="F")


class _Part(InputPartition):
    def __init__(self, path: str, begin: int, end: int | None):
        self.path, self.begin, self.end = path, begin, end


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p for p in options.get("path", "").split(",") if p]
        self.chunk = int(options.get("chunk", CHUNK))

    def partitions(self):
        out = []
        for p in self.paths:
            if p.endswith(".gz"):
                out.append(_Part(p, 0, None))
            else:
                n = header_of(p).shape[3]
                out += [_Part(p, b, min(b + GROUP, n)) for b in range(0, n, GROUP)]
        return out

    def read(self, part):
        import pyarrow as pa

        for t, v in chunks(part.path, self.chunk, part.begin, part.end):
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * v.shape[1], pa.int32()), pa.array(v.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array([part.path] * len(v)), pa.array(np.arange(t, t + len(v)), pa.int32()), lists], ["path", "t", "v"])


def header_of(path: str) -> Header:
    """The header of a 4D image."""
    with _open(path) as f:
        h = parse_header(f.read(352))
    if len(h.shape) != 4:
        raise ValueError(f"expected a 4D image, not {len(h.shape)}D: {path}")
    return h


def chunks(path: str, size: int = CHUNK, begin: int = 0, end: int | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(first t, volumes as rows of voxels) of a 4D image, at most `size` volumes at a time, in one pass."""
    with _open(path) as f:
        h = parse_header(f.read(352))
        end = h.shape[3] if end is None and len(h.shape) == 4 else end
        held: list[np.ndarray] = []
        for t, v in enumerate(read_volumes(f, h, begin, end or 0), begin):
            held.append(v.ravel())
            if len(held) == size:
                yield t + 1 - size, np.stack(held)
                held = []
        if held:
            yield end - len(held), np.stack(held)


def mask_of(path: str) -> np.ndarray:
    """Whether each voxel of a mask image is above 0."""
    with open(path, "rb") as f:
        _, data = decode(f.read())
    return (data > 0).ravel()


def node_means(runs: DataFrame, membership: DataFrame, n_nodes: int) -> DataFrame:
    """runs(path, run_key, mask or null) and membership(node_idx, vox_id), a multiset -> run_key, t, v (array<float>): the mean of each node in double precision, NaN for a node without voxels.

    The membership goes to every task: it has as many rows as nodes have voxels, which the image bounds, and MEMBERSHIP_ROWS checks. Each run is one task's work."""
    rows = membership.select(F.col("node_idx").cast("int").alias("node_idx"), F.col("vox_id").cast("int").alias("vox_id")).limit(MEMBERSHIP_ROWS + 1).toPandas()
    if len(rows) > MEMBERSHIP_ROWS:
        raise ValueError(f"a membership of more than {MEMBERSHIP_ROWS} voxels")
    rows = rows.sort_values(["node_idx", "vox_id"], kind="stable")
    of, vox = rows["node_idx"].to_numpy(np.int32), rows["vox_id"].to_numpy(np.int64)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for path, key, mask in zip(*(b.column(c).to_pylist() for c in ("path", "run_key", "mask")), strict=True):
                inside = mask_of(mask)[vox] if mask else np.ones(len(vox), bool)
                nodes, voxels = of[inside], vox[inside]
                held, begin, count = np.unique(nodes, return_index=True, return_counts=True)
                for t, v in chunks(path):
                    means = np.full((len(v), n_nodes), np.nan, np.float32)
                    if len(held):
                        means[:, held] = np.add.reduceat(v[:, voxels].astype(np.float64), begin, axis=1) / count
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * n_nodes, pa.int32()), pa.array(means.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(v)), pa.array(np.arange(t, t + len(v)), pa.int32()), lists], ["run_key", "t", "v"])

    # A run in each task, as a task's time is a file's.
    spread = runs.select("path", "run_key", "mask").repartitionByRange(max(1, runs.count()), "path")
    return spread.mapInArrow(run, "run_key string, t int, v array<float>")


class NiftiSource(DataSource):
    @classmethod
    def name(cls):
        return "nifti"

    def schema(self):
        return "path string, t int, v array<float>"

    def reader(self, schema):
        return _Reader(self.options)


def volumes(spark: SparkSession, paths: list[str], chunk: int = CHUNK) -> DataFrame:
    """path, t, v of 4D images on a file system that all executors mount."""
    spark.dataSource.register(NiftiSource)
    return spark.read.format("nifti").option("chunk", chunk).load(",".join(paths))


def volumes_anywhere(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The same from any store that Spark reads; a task holds one file."""
    raw = spark.read.format("binaryFile").load(paths).select("path", "content")

    def run(batches):
        import pandas as pd

        for frame in batches:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                body = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
                h = parse_header(body[:352])
                for b in range(0, h.shape[3] if len(h.shape) == 4 else 1, CHUNK):
                    e = min(b + CHUNK, h.shape[3])
                    yield pd.DataFrame({"path": path, "t": range(b, e), "v": [v.ravel() for v in read_volumes(io.BytesIO(body), h, b, e)]})

    return raw.mapInPandas(run, "path string, t int, v array<float>")


def label_image(spark: SparkSession, path: str) -> tuple[DataFrame, Header]:
    """A 3D label image (a last axis of 1 is dropped) as vox_id, i, j, k, label; 0 is included."""
    content = spark.read.format("binaryFile").load(path).select("content").first()[0]  # one image of an atlas
    h, data = decode(bytes(content))
    data = data.reshape(data.shape[:3]) if data.ndim == 4 and data.shape[3] == 1 else data
    if data.ndim != 3:
        raise ValueError("a label image has three dimensions")
    flat = np.rint(data).astype(np.int32).ravel()
    ijk = np.indices(data.shape).reshape(3, -1)
    import pandas as pd

    frame = pd.DataFrame({"vox_id": np.arange(flat.size), "i": ijk[0], "j": ijk[1], "k": ijk[2], "label": flat})
    return spark.createDataFrame(frame, "vox_id long, i int, j int, k int, label int"), h


def mask_voxels(spark: SparkSession, path: str) -> DataFrame:
    """vox_id of the voxels above 0 of a mask image."""
    return label_image(spark, path)[0].filter(F.col("label") > 0).select("vox_id")
