"""LAS point clouds, formats 0 to 10 without compression (ASPRS LAS 1.2 to 1.4).

Files come through Spark's binary reader, so any store that Spark reads will do; a task turns one file into Arrow batches
of BATCH points; a file that is cut short is an error. Only the fields that all formats share are returned.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH, HEADER = 1 << 17, 375
SCHEMA = "path string, point long, x double, y double, z double, intensity int, classification int, gps_time double"
TIMED = {1: 20, 3: 20, 4: 20, 5: 20}  # fixed values: where the GPS time stands in a record, by format; 22 from format 6 on


def header(data: bytes) -> dict:
    """From the first HEADER bytes of a file."""
    if data[:4] != b"LASF":
        raise ValueError("not a LAS file")
    (start,), kind, (size, count) = struct.unpack_from("<I", data, 96), data[104], struct.unpack_from("<HI", data, 105)
    if kind & 0x80:
        raise ValueError("compressed points")
    if data[25] >= 4:
        (count,) = struct.unpack_from("<Q", data, 247)
    return {"start": start, "format": kind, "size": size, "count": count, "scale": struct.unpack_from("<3d", data, 131), "offset": struct.unpack_from("<3d", data, 155)}


def layout(kind: int, size: int) -> np.dtype:
    """Of a record; formats from 6 on have a whole byte for the class, older ones five bits."""
    at = {"x": ("<i4", 0), "y": ("<i4", 4), "z": ("<i4", 8), "intensity": ("<u2", 12), "class": ("u1", 16 if kind >= 6 else 15)}
    if kind >= 6 or kind in TIMED:
        at["time"] = ("<f8", 22 if kind >= 6 else TIMED[kind])
    return np.dtype({"names": list(at), "formats": [t for t, _ in at.values()], "offsets": [o for _, o in at.values()], "itemsize": size})


def _points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
            data = content.as_buffer()
            h = header(data.slice(0, min(HEADER, data.size)).to_pybytes())
            if h["start"] + h["count"] * h["size"] > data.size:
                raise ValueError(f"{path} is cut short: {data.size} bytes do not hold {h['count']} points")
            kind = layout(h["format"], h["size"])
            for lo in range(0, h["count"], BATCH):
                p = np.frombuffer(data, kind, min(BATCH, h["count"] - lo), h["start"] + lo * h["size"])
                xyz = [pa.array(p[c] * s + o) for c, s, o in zip("xyz", h["scale"], h["offset"], strict=True)]
                cls = (p["class"] if h["format"] >= 6 else p["class"] & 31).astype(np.int32)
                time = pa.array(p["time"]) if "time" in kind.names else pa.nulls(len(p), pa.float64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * len(p)), pa.array(np.arange(lo, lo + len(p))), *xyz, pa.array(p["intensity"].astype(np.int32)), pa.array(cls), time],
                    names=["path", "point", "x", "y", "z", "intensity", "classification", "gps_time"],
                )


def read_las(spark: SparkSession, path: str) -> DataFrame:
    """A row per point of each *.las file under ``path``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.las").load(path).select("path", "content")
    return files.mapInArrow(_points, SCHEMA)


RECORD = np.dtype({"names": ["xyz", "intensity", "returns", "class", "time"], "formats": ["3<i4", "<u2", "u1", "u1", "<f8"], "offsets": [0, 12, 14, 16, 22], "itemsize": 30})  # fixed values: format 6


class Growing:
    """A LAS 1.4 file of format 6 that grows by batches: x, y, z, intensity, classification, gps_time. It is held once, as its own bytes.

    Places count from the first batch's low ends, so they may be negative.
    """

    def __init__(self, scale: float) -> None:
        self.scale, self.count, self.data = scale, 0, bytearray(HEADER)
        self.low, self.least, self.most = None, np.full(3, np.inf), np.full(3, -np.inf)

    def add(self, points: dict[str, np.ndarray]) -> None:
        xyz = np.stack([points[c] for c in "xyz"], axis=1)
        if self.low is None:
            self.low = np.floor(xyz.min(axis=0))
        whole = np.floor((xyz - self.low) / self.scale + 0.5)
        if np.abs(whole).max() >= 2**31:
            raise ValueError("points lie too far apart for this scale")
        body = np.zeros(len(xyz), RECORD)
        body["xyz"], body["returns"] = whole, 0x11
        for column, name in (("intensity", "intensity"), ("class", "classification"), ("time", "gps_time")):
            body[column] = points[name]
        kept = whole * self.scale + self.low
        self.least, self.most = np.minimum(self.least, kept.min(axis=0)), np.maximum(self.most, kept.max(axis=0))
        self.data += body.tobytes()
        self.count += len(xyz)

    def content(self) -> bytearray:
        head = self.data
        head[:4], head[24], head[25], head[104] = b"LASF", 1, 4, 6
        struct.pack_into("<HII", head, 94, HEADER, HEADER, 0)
        struct.pack_into("<H", head, 105, RECORD.itemsize)
        ends = [v for lo, hi in zip(self.least, self.most, strict=True) for v in (hi, lo)]
        struct.pack_into("<12d", head, 131, *[self.scale] * 3, *self.low, *ends)
        struct.pack_into("<2Q", head, 247, self.count, self.count)  # all points, and those of the first return
        return head


def file_of(points: dict[str, np.ndarray], scale: float) -> bytes:
    """A LAS 1.4 file of format 6: x, y, z, intensity, classification, gps_time."""
    file = Growing(scale)
    file.add(points)
    return bytes(file.content())


def write_las(points: DataFrame, scale: float = 0.01, most: int = 10_000_000) -> DataFrame:
    """points (x, y, z and, if there, intensity, classification, gps_time) -> (name, content): LAS files of at most ``most`` points of a task each.

    A file is held in its task's memory (30 bytes a point). Rows without a place are left out; other nulls are zero.
    """
    kinds = {"x": "double", "y": "double", "z": "double", "intensity": "int", "classification": "int", "gps_time": "double"}
    rows = points.where("x is not null and y is not null and z is not null").select(*((F.coalesce(F.col(c).cast(t), F.lit(0).cast(t)) if c in points.columns else F.lit(0).cast(t)).alias(c) for c, t in kinds.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, number = Growing(scale), 0
        part = TaskContext.get().partitionId()

        def made() -> pa.RecordBatch:
            content = pa.py_buffer(file.content())  # not copied
            held = pa.Array.from_buffers(pa.binary(), 1, [None, pa.py_buffer(np.array([0, content.size], np.int32)), content])
            return pa.RecordBatch.from_arrays([pa.array([f"part-{part:05d}-{number:04d}.las"]), held], names=["name", "content"])

        for b in batches:
            for at in range(0, b.num_rows, most):
                piece = b.slice(at, most)
                if file.count and file.count + piece.num_rows > most:
                    yield made()
                    file, number = Growing(scale), number + 1
                file.add({c: piece.column(c).to_numpy(zero_copy_only=False) for c in kinds})
        if file.count:
            yield made()

    return rows.mapInArrow(run, "name string, content binary")
