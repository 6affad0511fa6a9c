"""Shapefiles: geometry of *.shp and attributes of *.dbf, joined by file and record number (ESRI, 1998).

A task reads one file; records come out in Arrow batches. Multipatches and null shapes have no vertices.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH = 10_000
SET, SET_BYTES = 50_000, 1 << 26  # records, and bytes of vertices, from which on a written set is closed
KINDS = {0: "null", 1: "point", 3: "line", 5: "polygon", 8: "multipoint"}  # fixed values; 10 more with heights, 20 more with measures
POINT = pa.struct([("x", pa.float64()), ("y", pa.float64()), ("z", pa.float64())])


def shape(data: bytes) -> tuple[str, list[int], np.ndarray]:
    """One record's content -> kind, first vertex of each part, vertices as rows of x, y, z (nan without heights)."""
    (code,) = struct.unpack_from("<i", data)
    kind, with_z = KINDS.get(code % 10), 10 < code < 20
    if code == 0 or kind is None or code > 28:
        return "null", [], np.zeros((0, 3))
    if kind == "point":
        x, y, *z = struct.unpack_from("<3d" if with_z else "<2d", data, 4)
        return kind, [0], np.array([[x, y, z[0] if z else np.nan]])
    parts, at = [0], 40
    if kind == "multipoint":
        (n,) = struct.unpack_from("<i", data, 36)
    else:
        n_parts, n = struct.unpack_from("<2i", data, 36)
        parts, at = list(struct.unpack_from(f"<{n_parts}i", data, 44)), 44 + 4 * n_parts
    out = np.full((n, 3), np.nan)
    out[:, :2] = np.frombuffer(data, "<f8", 2 * n, at).reshape(n, 2)
    if with_z:
        out[:, 2] = np.frombuffer(data, "<f8", n, at + 16 * n + 16)
    return kind, parts, out


def records(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(record number from 1, content)."""
    if struct.unpack_from(">i", data)[0] != 9994:
        raise ValueError("not a shapefile")
    at = 100
    while at + 8 <= len(data):
        number, words = struct.unpack_from(">2i", data, at)
        yield number, data[at + 8 : at + 8 + 2 * words]
        at += 8 + 2 * words


def attributes(data: bytes, encoding: str) -> Iterator[tuple[int, dict[str, str]]]:
    """(record number from 1, name -> text) of a dBase table; deleted records keep their number and have no attributes."""
    count, start, size = struct.unpack_from("<IHH", data, 4)
    fields, at, place = [], 32, 1
    while data[at] != 0x0D:
        fields.append((data[at : at + 11].split(b"\0")[0].decode(encoding), place, place + data[at + 16]))
        place += data[at + 16]
        at += 32
    for i in range(count):
        row = data[start + i * size : start + (i + 1) * size]
        yield i + 1, {} if row[:1] == b"*" else {name: row[a:b].decode(encoding).strip() for name, a, b in fields}


def _stem(path: str) -> str:
    return path.rpartition(".")[0]


def _shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, binary in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
            data = binary.as_py()
            held: list[tuple] = []
            for number, content in records(data):
                kind, parts, p = shape(content)
                held.append((_stem(path), number, kind, parts, [{"x": x, "y": y, "z": None if z != z else z} for x, y, z in p.tolist()]))
                if len(held) == BATCH:
                    yield _batch(held)
                    held = []
            if held:
                yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(POINT))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["file", "record", "kind", "parts", "pts"])


def read_shapefile(spark: SparkSession, path: str, encoding: str = "latin-1") -> DataFrame:
    """A row per record of each shapefile under ``path``: file, record, kind, parts, pts, attributes (a map, null without a table)."""

    def table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                rows = attributes(content.as_py(), encoding)
                while part := list(islice(rows, BATCH)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([_stem(name)] * len(part)), pa.array([n for n, _ in part], pa.int64()), pa.array([list(a.items()) for _, a in part], pa.map_(pa.string(), pa.string()))],
                        names=["file", "record", "attributes"],
                    )

    read = lambda glob: spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")
    shapes = read("*.shp").mapInArrow(_shapes, "file string, record long, kind string, parts array<int>, pts array<struct<x:double,y:double,z:double>>")
    return shapes.join(read("*.dbf").mapInArrow(table, "file string, record long, attributes map<string,string>"), ["file", "record"], "left")


def parts_of(features: DataFrame) -> DataFrame:
    """A row per part of each feature: its own vertices."""
    n = F.size("parts")
    end = F.when(F.col("part") + 1 < n, F.col("parts")[F.col("part") + 1]).otherwise(F.size("pts"))
    some = features.select("*", F.posexplode("parts").alias("part", "begin"))
    return some.withColumn("pts", F.slice("pts", F.col("begin") + 1, end - F.col("begin"))).drop("parts", "begin")


CODES = {"null": 0, "point": 1, "line": 3, "polygon": 5, "multipoint": 8}  # fixed values


def content_of(kind: str, parts: list[int], pts: np.ndarray) -> bytes:
    """A record's content; with heights (code + 10) if all vertices have one."""
    code = CODES[kind] if len(pts) else 0
    if code == 0:
        return struct.pack("<i", 0)
    with_z = not np.isnan(pts[:, 2]).any()
    z = np.ascontiguousarray(pts[:, 2], "<f8")
    code += 10 * with_z
    if kind == "point":
        return struct.pack("<i2d", code, *pts[0, :2]) + (struct.pack("<2d", z[0], 0.0) if with_z else b"")
    head = struct.pack("<i4d", code, *pts[:, :2].min(axis=0), *pts[:, :2].max(axis=0))
    counts = struct.pack("<i", len(pts)) if kind == "multipoint" else struct.pack(f"<2i{len(parts)}i", len(parts), len(pts), *parts)
    heights = struct.pack("<2d", z.min(), z.max()) + z.tobytes() if with_z else b""
    return head + counts + np.ascontiguousarray(pts[:, :2], "<f8").tobytes() + heights


def _header(kind: str, size: int, frame: np.ndarray, with_z: bool) -> bytes:
    return struct.pack(">i5ii", 9994, 0, 0, 0, 0, 0, size // 2) + struct.pack("<2i8d", 1000, CODES[kind] + 10 * with_z, *frame, 0.0, 0.0)


def table_of(rows: list[dict[str, str]], encoding: str) -> bytes:
    """A dBase table of text fields; names are cut to ten letters and made different, texts to 254 bytes."""
    names: dict[str, str] = {}
    for name in dict.fromkeys(n for r in rows for n in r):
        short, k = name[:10], 0
        while short.upper() in {s.upper() for s in names.values()}:
            k += 1
            short = f"{name[: 10 - len(str(k))]}{k}"
        names[name] = short
    names = names or {"id": "id"}
    texts = [[(r.get(n) or "").encode(encoding, "replace")[:254] for n in names] for r in rows]
    sizes = [max([1, *(len(t[i]) for t in texts)]) for i in range(len(names))]
    head = struct.pack("<4BIHH20x", 3, 100, 1, 1, len(rows), 33 + 32 * len(names), 1 + sum(sizes))
    fields = b"".join(struct.pack("<11sc4xB15x", s.encode(encoding, "replace"), b"C", n) for s, n in zip(names.values(), sizes, strict=True))
    return head + fields + b"\r" + b"".join(b" " + b"".join(x.ljust(n) for x, n in zip(t, sizes, strict=True)) for t in texts) + b"\x1a"


def write_shapefiles(features: DataFrame, encoding: str = "latin-1") -> DataFrame:
    """features (kind, parts, pts and, if there, attributes) -> (name, content): the .shp, .shx and .dbf files of each task's rows.

    A shapefile holds one kind, so a task gives sets of files for each kind it has; null shapes go to any set. A set is held in
    the task's memory, and closed at SET records or SET_BYTES of vertices, so memory does not grow with the table. Heights are written where all shapes of the set have them.
    """
    has_table = "attributes" in features.columns
    columns = ["kind", "parts", "pts", *(["attributes"] if has_table else [])]

    def made(kind: str, rows: list[tuple[list[int], np.ndarray, dict]], number: int) -> pa.RecordBatch:
        part = TaskContext.get().partitionId()
        stem = f"part-{part:05d}" + (f"-{number:05d}" if number else "")
        flat = any(np.isnan(p[:, 2]).any() for _, p, _ in rows)
        for _, p, _ in rows:
            if flat:
                p[:, 2] = np.nan
        some = [p[:, :2] for _, p, _ in rows if len(p)]
        every = np.concatenate(some) if some else np.zeros((1, 2))
        high = np.concatenate([p[:, 2] for _, p, _ in rows])
        heights = [0.0, 0.0] if flat or not len(high) else [high.min(), high.max()]
        frame, with_z = [*every.min(axis=0), *every.max(axis=0), *heights], not flat and bool(some)
        contents = [content_of(kind, parts, p) for parts, p, _ in rows]
        body = b"".join(struct.pack(">2i", i, len(c) // 2) + c for i, c in enumerate(contents, 1))
        sizes = np.array([len(c) for c in contents])
        places = 100 + np.cumsum(sizes + 8) - sizes - 8
        index = np.stack([places // 2, sizes // 2], axis=1).astype(">i4").tobytes()
        files = {"shp": _header(kind, 100 + len(body), frame, with_z) + body, "shx": _header(kind, 100 + len(index), frame, with_z) + index, "dbf": table_of([a for _, _, a in rows], encoding)}
        return pa.RecordBatch.from_arrays([pa.array([f"{stem}-{kind}.{x}" for x in files]), pa.array(list(files.values()), pa.binary())], names=["name", "content"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[str, list[tuple[list[int], np.ndarray, dict]]] = {}
        held: dict[str, int] = {}
        closed: dict[str, int] = {}

        def close(kind: str) -> pa.RecordBatch:
            closed[kind] = closed.get(kind, 0) + 1
            held[kind] = 0
            return made(kind, sets.pop(kind), closed[kind] - 1)

        for b in batches:
            for row in (r for lo in range(0, b.num_rows, 1000) for r in b.slice(lo, 1000).to_pylist()):
                pts = np.array([(p["x"], p["y"], np.nan if p["z"] is None else p["z"]) for p in row["pts"] or ()], float).reshape(-1, 3)
                kind = row["kind"] if len(pts) else next(iter(sets), "point")
                sets.setdefault(kind, []).append((row["parts"] or [], pts, dict(row.get("attributes") or ())))
                held[kind] = held.get(kind, 0) + pts.nbytes
                if len(sets[kind]) >= SET or held[kind] >= SET_BYTES:
                    yield close(kind)
        for kind in list(sets):
            yield close(kind)

    return features.select(*columns).mapInArrow(run, "name string, content binary")
