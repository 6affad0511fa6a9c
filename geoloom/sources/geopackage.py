"""GeoPackages (OGC 12-128): feature tables with their geometry, frame and attributes in one scan.

A task reads one file: its bytes are opened in memory, so any store that Spark reads will do. Rows come out in Arrow batches.
"""

from __future__ import annotations

import sqlite3
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from geoloom.sources import wkb

BATCH = 5000
ENVELOPES = {0: 0, 1: 4, 2: 6, 3: 6, 4: 8}  # fixed values: numbers in the envelope by its code
SCHEMA = f"file string, layer string, srs int, fid long, {wkb.SCHEMA}, xmin double, ymin double, xmax double, ymax double, zmin double, zmax double, attributes map<string,string>"


def header(blob: bytes) -> tuple[int, list[float], bytes]:
    """srs, frame (xmin, ymin, xmax, ymax, zmin, zmax; empty if there is no envelope), the geometry's own bytes."""
    if blob[:2] != b"GP":
        raise ValueError("not a GeoPackage geometry")
    flags = blob[3]
    order, code = "<" if flags & 1 else ">", flags >> 1 & 7
    if code not in ENVELOPES:
        raise ValueError(f"envelope code {code}")
    (srs,) = struct.unpack_from(f"{order}i", blob, 4)
    e = struct.unpack_from(f"{order}{ENVELOPES[code]}d", blob, 8)
    frame = [e[0], e[2], e[1], e[3], *(e[4:6] if code in (2, 4) else (np.nan, np.nan))] if e else []
    return srs, frame, blob[8 + 8 * len(e) :]


def _features(name: str, data: bytes) -> Iterator[tuple]:
    base = sqlite3.connect(":memory:")
    base.deserialize(data)
    base.text_factory = lambda b: b.decode("utf-8", "replace")
    quoted = lambda n: '"' + n.replace('"', '""') + '"'
    tables = base.execute("SELECT c.table_name, g.column_name FROM gpkg_contents c JOIN gpkg_geometry_columns g ON g.table_name = c.table_name WHERE c.data_type = 'features' ORDER BY 1").fetchall()
    for table, column in tables:
        columns = base.execute(f"PRAGMA table_info({quoted(table)})").fetchall()
        key = next((c[1] for c in columns if c[5]), "rowid")
        others = [c[1] for c in columns if c[1] not in (key, column)]
        for fid, blob, *values in base.execute(f"SELECT {', '.join(['rowid' if key == 'rowid' else quoted(key), quoted(column), *map(quoted, others)])} FROM {quoted(table)} ORDER BY 1"):
            srs, frame, kind, parts, pts = None, [], None, None, None
            if blob is not None:
                srs, frame, body = header(blob)
                kind, parts, pts = wkb.decode(body)
                if not frame and len(pts):
                    z = pts[:, 2]
                    frame = [*pts[:, :2].min(axis=0), *pts[:, :2].max(axis=0), *((np.nan, np.nan) if np.isnan(z).all() else (np.nanmin(z), np.nanmax(z)))]
            frame = [None if f != f else float(f) for f in frame] or [None] * 6
            text = [(n, v.hex() if isinstance(v, bytes) else str(v)) for n, v in zip(others, values, strict=True) if v is not None]
            yield name, table, srs, fid, kind, parts, None if pts is None else wkb.as_rows(pts), *frame, text
    base.close()


def read_geopackage(spark: SparkSession, path: str) -> DataFrame:
    """A row per feature of each GeoPackage under ``path``; a file is read by one task and held in its memory."""
    kinds = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(wkb.POINT), *(pa.float64(),) * 6, pa.map_(pa.string(), pa.string()))
    names = ["file", "layer", "srs", "fid", "kind", "parts", "pts", "xmin", "ymin", "xmax", "ymax", "zmin", "zmax", "attributes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                held: list[tuple] = []
                for row in _features(name, data):
                    held.append(row)
                    if len(held) == BATCH:
                        yield batch(held)
                        held = []
                if held:
                    yield batch(held)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gpkg").load(path).select("path", "content").mapInArrow(run, SCHEMA)
