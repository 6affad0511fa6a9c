"""Well-known binary geometries (OGC 06-103r4): points, lines, polygons, their multiples and collections, with heights and measures.

A decoded geometry is what shapefiles give: a kind, the first vertex of each part, the vertices with their heights.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

KINDS = {1: "point", 2: "line", 3: "polygon", 4: "multipoint", 5: "multiline", 6: "multipolygon", 7: "collection"}  # fixed values
POINT = pa.struct([("x", pa.float64()), ("y", pa.float64()), ("z", pa.float64())])
SCHEMA = "kind string, parts array<int>, pts array<struct<x:double,y:double,z:double>>"


def _kind(code: int) -> tuple[int, bool, bool]:
    """Kind, with heights, with measures: thousands of the standard, or the high bits of the extended form."""
    with_z, with_m, code = bool(code & 0x80000000), bool(code & 0x40000000), code & 0x0FFFFFFF
    return code % 1000, with_z or code // 1000 in (1, 3), with_m or code // 1000 in (2, 3)


def decode(data: bytes) -> tuple[str, list[int], np.ndarray]:
    """kind, first vertex of each part, vertices as rows of x, y, z (nan without heights). An empty geometry has no vertices."""
    parts: list[int] = []
    held: list[np.ndarray] = []
    count = 0

    def vertices(at: int, n: int, order: str, with_z: bool, with_m: bool) -> int:
        nonlocal count
        width = 2 + with_z + with_m
        raw = np.frombuffer(data, f"{order}f8", n * width, at).reshape(n, width)
        out = np.full((n, 3), np.nan)
        out[:, : 2 + with_z] = raw[:, : 2 + with_z]
        if n and not (n == 1 and np.isnan(out[0, 0])):
            parts.append(count)
            held.append(out)
            count += n
        return at + 8 * n * width

    def geometry(at: int) -> tuple[int, int]:
        if data[at] > 1:
            raise ValueError("not a well-known binary")
        order = "<" if data[at] else ">"
        kind, with_z, with_m = _kind(struct.unpack_from(f"{order}I", data, at + 1)[0])
        at += 5
        if kind == 1:
            return vertices(at, 1, order, with_z, with_m), kind
        if kind not in KINDS:
            raise ValueError(f"geometry kind {kind}")
        (n,) = struct.unpack_from(f"{order}I", data, at)
        at += 4
        if kind == 2:
            return vertices(at, n, order, with_z, with_m), kind
        for _ in range(n):
            if kind == 3:
                (size,) = struct.unpack_from(f"{order}I", data, at)
                at = vertices(at + 4, size, order, with_z, with_m)
            else:
                at, _ = geometry(at)
        return at, kind

    _, kind = geometry(0)
    return KINDS[kind], parts, np.concatenate(held) if held else np.zeros((0, 3))


def encode(kind: str, parts: list[int], pts: np.ndarray) -> bytes:
    """The other way, little-endian; heights are written if all vertices have one. Each part of a multipolygon becomes a polygon of its own."""
    code = {v: k for k, v in KINDS.items()}[kind]
    with_z = bool(len(pts)) and not np.isnan(pts[:, 2]).any()
    more, width = (1000, 3) if with_z else (0, 2)
    ends = [*parts[1:], len(pts)]
    body = [np.ascontiguousarray(pts[a:b, :width], "<f8").tobytes() for a, b in zip(parts, ends, strict=True)]
    sizes = [struct.pack("<I", b - a) for a, b in zip(parts, ends, strict=True)]
    head = lambda k: struct.pack("<BI", 1, k + more)
    if code == 1:
        return head(1) + (body[0] if body else struct.pack("<2d", np.nan, np.nan))
    if code == 2:
        return head(2) + (sizes[0] + body[0] if body else struct.pack("<I", 0))
    if code == 3:
        return head(3) + struct.pack("<I", len(parts)) + b"".join(map(bytes.__add__, sizes, body))
    if code == 4:
        points = [head(1) + np.ascontiguousarray(p[:width], "<f8").tobytes() for p in pts]
        return head(4) + struct.pack("<I", len(points)) + b"".join(points)
    inner = [head(2) + s + b if code == 5 else head(3) + struct.pack("<I", 1) + s + b for s, b in zip(sizes, body, strict=True)]
    return head(code) + struct.pack("<I", len(inner)) + b"".join(inner)


def as_rows(pts: np.ndarray) -> list[dict]:
    return [{"x": x, "y": y, "z": None if z != z else z} for x, y, z in pts.tolist()]


def from_wkb(rows: DataFrame, column: str) -> DataFrame:
    """rows with the geometry of a binary column as kind, parts, pts, with underscores where rows have such columns; null stays null."""
    names, schema = [*rows.columns], StructType([*rows.schema.fields])
    vertex = StructType([StructField(c, DoubleType()) for c in "xyz"])
    made_names = []
    for name, kind in (("kind", StringType()), ("parts", ArrayType(IntegerType())), ("pts", ArrayType(vertex))):
        while name.lower() in {c.lower() for c in names}:
            name += "_"
        made_names.append(name)
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [(None, None, None) if x is None else ((d := decode(x))[0], d[1], as_rows(d[2])) for x in b.column(column).to_pylist()]
            kinds = (pa.string(), pa.list_(pa.int32()), pa.list_(POINT))
            new = [pa.array([m[i] for m in made], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[*names, *made_names])

    return rows.mapInArrow(run, schema)
