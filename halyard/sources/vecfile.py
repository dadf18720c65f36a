"""Vector files: a 20-byte header, then 32-bit floats, all little-endian.

Header: the magic bytes, version 1, dimension (32 bits each), count (64 bits).
Reading is distributed by file; the engine's own storage is Parquet.
"""

from __future__ import annotations

import struct
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import CorruptData

# fixed values of the format
MAGIC, VERSION, HEADER = b"ATVX", 1, struct.Struct("<4sIIQ")
#: Bytes of a file that is written, about.
FILE_BYTES = 64 << 20


def pack(vectors: np.ndarray) -> bytes:
    """A file's bytes of a rows x dimension matrix."""
    v = np.ascontiguousarray(vectors, "<f4")
    if v.ndim != 2:
        raise ValueError("vectors must be a matrix")
    return HEADER.pack(MAGIC, VERSION, v.shape[1], v.shape[0]) + v.tobytes()


def unpack(data: bytes, dimension: int | None = None, count: int | None = None) -> np.ndarray:
    if len(data) < HEADER.size:
        raise CorruptData("vector file is shorter than its header")
    magic, version, dim, n = HEADER.unpack_from(data)
    if magic != MAGIC:
        raise CorruptData("vector file has a wrong magic")
    if version != VERSION:
        raise CorruptData(f"vector file has version {version}")
    if dimension is not None and dim != dimension:
        raise CorruptData(f"vector file has dimension {dim}, expected {dimension}")
    if count is not None and n != count:
        raise CorruptData(f"vector file has {n} vectors, expected {count}")
    if len(data) != HEADER.size + 4 * dim * n:
        raise CorruptData("vector file has a wrong size")
    return np.frombuffer(data, "<f4", offset=HEADER.size).reshape(n, dim)


def read(spark: SparkSession, path: str, dimension: int | None = None) -> DataFrame:
    """file, id (place in its file), vector of all vector files under a path. A file
    is one value of a task: :func:`write` keeps files small."""

    def run(batches):
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                v = unpack(data, dimension)
                for at in range(0, len(v), 4096):
                    s = v[at : at + 4096]
                    offsets = pa.array(np.arange(len(s) + 1) * v.shape[1], pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(s)), pa.array(np.arange(at, at + len(s))), pa.ListArray.from_arrays(offsets, pa.array(s.reshape(-1)))], ["file", "id", "vector"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "file string, id long, vector array<float>")


def write(df: DataFrame, path: str, dimension: int, file_bytes: int = FILE_BYTES) -> None:
    """Vector files of (id, vector) in id order, about ``file_bytes`` each.

    Rows are dealt by ranges of ids; the task that holds a range writes its file
    beside the target (through the file system of the folder's URI), and the driver
    renames what tasks report: an attempt that was lost or doubled leaves nothing
    behind, and no vector passes the driver."""
    from .fs import FileSystem

    fs = FileSystem(df.sparkSession)
    staged = f"{path.rstrip('/')}/_staged-{uuid.uuid4().hex}"
    system, at = fs._at(staged)
    system.mkdirs(at)
    uri = fs.qualified(staged)

    def run(batches):
        from pyarrow import fs as pafs
        from pyspark import TaskContext

        ids, rows = [], []
        for b in batches:
            flat = b.column(1).flatten()
            if b.column(1).null_count or len(flat) != dimension * b.num_rows:
                raise ValueError(f"a vector has not {dimension} components")
            ids.append(b.column(0).to_numpy())
            rows.append(flat.to_numpy().reshape(-1, dimension))
        if ids:
            ids, rows = np.concatenate(ids), np.concatenate(rows)
            context = TaskContext.get()
            name = f"{context.partitionId():05d}-{context.taskAttemptId()}"
            target, folder = pafs.FileSystem.from_uri(uri)
            with target.open_output_stream(f"{folder}/{name}") as out:
                out.write(pack(rows[np.argsort(ids, kind="stable")]))
            yield pa.RecordBatch.from_arrays([pa.array([context.partitionId()]), pa.array([name])], ["part", "name"])

    try:
        files = max(1, -(-df.count() * 4 * dimension // file_bytes))
        packed = df.select("id", F.col("vector").cast("array<float>").alias("vector")).repartitionByRange(files, "id")
        for r in packed.mapInArrow(run, "part long, name string").collect():
            system.rename(fs._at(f"{staged}/{r['name']}")[1], fs._at(f"{path.rstrip('/')}/part-{r['part']:05d}.vec")[1])
    finally:
        fs.delete(staged)
