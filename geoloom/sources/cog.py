"""Cloud-optimised GeoTIFF: tiled rasters with overviews, as a data source that reads the tiles of a frame from the overview that is wanted.

A file's images form a pyramid: the first is the whole, the others overviews by a factor; masks are passed over. The largest factor that is
no larger than the one wanted is chosen, its tiles that meet the frame are dealt to partitions of at most A_PART tiles, and tasks read
the ranges of these tiles alone. A file of one image, or of strips, is read as its own only level.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from geoloom.functions.geometry import Frame
from geoloom.sources import tiff
from geoloom.sources.files import place

SCHEMA = "path string, factor long, row_ long, col long, band int, x double, y double, value double"
SUBFILE, MASK = 254, 4  # fixed values: a tag and its bit for masks
A_PART = 64


@dataclass(frozen=True)
class Level:
    factor: int
    order: str
    tags: dict[int, tuple]


def levels(read) -> list[Level]:
    """The images of a file from the finest on, for as long as they are tiled and of the same shape."""
    kind, at = tiff.opened(read)
    out: list[Level] = []
    while at:
        t, at = kind.directory(read, at)
        if t.get(SUBFILE, (0,))[0] & MASK:
            continue
        if out:
            first = out[0].tags
            across, down = first[tiff.WIDTH][0] / t[tiff.WIDTH][0], first[tiff.HEIGHT][0] / t[tiff.HEIGHT][0]
            if tiff.TILES not in first or tiff.TILES not in t or abs(across - down) > 10:
                break
            out.append(Level(round(across), kind.order, t))
        else:
            out.append(Level(1, kind.order, t))
    return out


def chosen(pyramid: list[Level], wanted: float) -> Level:
    return max((x for x in pyramid if x.factor <= wanted), key=lambda x: x.factor, default=pyramid[0])


def corner(pyramid: list[Level], level: Level) -> tuple[float, float, float, float] | None:
    """x and y of the image's first corner and the steps from pixel to pixel of a level; None without a place."""
    at = tiff.placing(pyramid[0].tags)
    if not at:
        return None
    return at[0] - at[2] / 2, at[1] - at[3] / 2, at[2] * level.factor, at[3] * level.factor  # a last pixel may stand for fewer


@dataclass
class Tiles(InputPartition):
    path: str
    level: Level
    corner: tuple[float, float, float, float] | None
    numbers: list[int]


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.wanted, self.frame = options["path"], float(options.get("factor", "1")), json.loads(options.get("frame", "null"))

    def partitions(self) -> Sequence[InputPartition]:
        system, at = place(self.path)
        if system.get_file_info(at).type == fs.FileType.File:
            files = [self.path]
        else:
            prefix = self.path[: len(self.path) - len(at)] if self.path.endswith(at) else ""
            files = sorted(prefix + x.path for x in system.get_file_info(fs.FileSelector(at, recursive=True)) if x.path.lower().endswith((".tif", ".tiff")))
        out: list[InputPartition] = []
        for path in files:
            with place(path)[0].open_input_file(place(path)[1]) as file:
                pyramid = levels(lambda o, n, file=file: file.read_at(n, o))
            level = chosen(pyramid, self.wanted)
            at, cut = corner(pyramid, level), tiff.Blocks(level.order, level.tags)
            wanted = [k for k, size in enumerate(cut.sizes) if size and self.meets(cut, at, k)]
            out += [Tiles(path, level, at, wanted[lo : lo + A_PART]) for lo in range(0, len(wanted), A_PART)]
        return out

    def meets(self, cut: tiff.Blocks, at: tuple | None, k: int) -> bool:
        if not self.frame or not at:
            return True
        r, c, _ = cut.place(k)
        x0, y0, x1, y1 = self.frame
        left, top = at[0] + c * at[2], at[1] + r * at[3]
        return left <= x1 and left + cut.w * at[2] >= x0 and top >= y0 and top + cut.h * at[3] <= y1

    def read(self, part: InputPartition) -> Iterator[pa.RecordBatch]:
        if not isinstance(part, Tiles):
            return
        t, at = part.level.tags, part.corner
        cut = tiff.Blocks(part.level.order, t)
        none = float(b"".join(t[tiff.NO_DATA]).strip(b"\0 ")) if tiff.NO_DATA in t else None
        with place(part.path)[0].open_input_file(place(part.path)[1]) as file:
            for k in part.numbers:
                r, c, band, values = cut.decoded(k, file.read_at(cut.sizes[k], cut.starts[k]))
                i, j, s = (a.ravel() for a in np.indices(values.shape))
                flat = values.ravel().astype(float)
                x, y = (at[0] + (j + c + 0.5) * at[2], at[1] + (i + r + 0.5) * at[3]) if at else (np.full(len(i), np.nan),) * 2
                inside = np.ones(len(i), bool) if not self.frame or not at else (x >= self.frame[0]) & (x <= self.frame[2]) & (y >= self.frame[1]) & (y <= self.frame[3])
                missing = np.isnan(flat) | (flat == none if none is not None else False)
                columns = [np.full(len(i), part.level.factor), i + r, j + c, (s + band).astype(np.int32)]
                placed = [pa.array(v[inside], mask=np.isnan(v[inside])) for v in (x, y)]
                yield pa.RecordBatch.from_arrays([pa.array([part.path] * int(inside.sum()), pa.string()), *(pa.array(v[inside]) for v in columns), *placed, pa.array(flat[inside], mask=missing[inside])], names=[f.split()[0] for f in SCHEMA.split(", ")])


class CogPixels(DataSource):
    """Pixels of *.tif and *.tiff files under ``path``."""

    @classmethod
    def name(cls) -> str:
        return "cog_pixels"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return Reader(dict(self.options))


def read_cog(spark: SparkSession, path: str, factor: float = 1, frame: Frame | None = None) -> DataFrame:
    """A row per pixel and band of the overview for ``factor`` (source pixels to a pixel), with ``frame`` of the pixels whose centre it holds; no-data is null."""
    spark.dataSource.register(CogPixels)
    reader = spark.read.format("cog_pixels").option("factor", str(factor))
    return (reader.option("frame", json.dumps([frame.xmin, frame.ymin, frame.xmax, frame.ymax])) if frame else reader).load(path)


def halved(v: np.ndarray) -> np.ndarray:
    """Means of two by two, of those that are there."""
    rows, cols = v.shape
    whole = np.full((rows + rows % 2, cols + cols % 2), np.nan)
    whole[:rows, :cols] = v
    four = whole.reshape(whole.shape[0] // 2, 2, -1, 2)
    n = (~np.isnan(four)).sum(axis=(1, 3))
    return np.where(n > 0, np.nansum(four, axis=(1, 3)) / np.maximum(n, 1), np.nan)


def file_of(values: np.ndarray, x: float, y: float, gsd: float, none: float, tile: int, overviews: int) -> bytes:
    """A tiled TIFF of 32-bit floats with overviews, each half the one before; x and y are the first pixel's corner."""
    images = [values]
    while len(images) <= overviews:
        images.append(halved(images[-1]))
    body, tables = bytearray(struct.pack("<2sHI", b"II", 42, 0)), []

    def put(data: bytes) -> int:
        body.extend(b"\0" * (len(body) % 2) + data)
        return len(body) - len(data)

    for n, v in enumerate(images):
        rows, cols = v.shape
        starts, sizes = [], []
        for r in range(0, rows, tile):
            for c in range(0, cols, tile):
                square = np.full((tile, tile), none, "<f4")
                part = v[r : r + tile, c : c + tile]
                square[: part.shape[0], : part.shape[1]] = np.where(np.isnan(part), none, part)
                data = zlib.compress(square.tobytes())
                starts.append(put(data))
                sizes.append(len(data))
        fields = {SUBFILE: (4, [int(n > 0)]), tiff.WIDTH: (4, [cols]), tiff.HEIGHT: (4, [rows]), tiff.BITS: (3, [32]), tiff.COMPRESSION: (3, [8]), 262: (3, [1]), tiff.SAMPLES: (3, [1]), tiff.TILE_WIDTH: (4, [tile]), tiff.TILE_HEIGHT: (4, [tile]), tiff.TILES: (4, starts), tiff.TILE_BYTES: (4, sizes), tiff.FORMAT: (3, [3]), tiff.NO_DATA: (2, [bytes([b]) for b in f"{none:.1f}\0".encode()])}
        if n == 0:
            fields |= {tiff.SCALE: (12, [gsd, gsd, 0.0]), tiff.TIE: (12, [0.0, 0.0, 0.0, x, y, 0.0])}
        tables.append(fields)
    where = 4  # of the place of the next directory
    for fields in tables:
        entries = []
        for tag, (kind, v) in sorted(fields.items()):
            data = struct.pack(f"<{len(v)}{tiff.TYPES[kind]}", *v)
            entries.append(struct.pack("<HHI", tag, kind, len(v)) + (data.ljust(4, b"\0") if len(data) <= 4 else struct.pack("<I", put(data))))
        at = put(struct.pack("<H", len(entries)) + b"".join(entries) + struct.pack("<I", 0))
        struct.pack_into("<I", body, where, at)
        where = at + 2 + 12 * len(entries)
    return bytes(body)


def write_cogs(nodes: DataFrame, x0: float, y0: float, gsd: float, side: int = 4096, tile: int = 256, overviews: int = 4, none: float = -9999.0) -> DataFrame:
    """nodes (row_, col, z) of a grid whose first node lies at x0, y0 -> (name, content): a file for each square of ``side`` nodes, which is one group (8 bytes a node in its task)."""
    known = nodes.where("row_ is not null and col is not null").groupBy("row_", "col").agg(F.max("z").cast("double").alias("z"))
    square = known.select(F.floor(F.col("row_") / side).alias("down"), F.floor(F.col("col") / side).alias("across"), "row_", "col", "z")

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        r, c = rows["row_"] - key[0] * side, rows["col"] - key[1] * side
        values = np.full((r.max() + 1, c.max() + 1), np.nan)
        values[r, c] = rows["z"]
        return pd.DataFrame({"name": [f"{key[0]:06d}-{key[1]:06d}.tif"], "content": [file_of(values, x0 + (key[1] * side - 0.5) * gsd, y0 - (key[0] * side - 0.5) * gsd, gsd, none, tile, overviews)]})

    return square.groupBy("down", "across").applyInPandas(run, "name string, content binary")
