"""TIFF and BigTIFF rasters: strips or tiles, without compression or by Deflate, LZW or PackBits, all predictors (TIFF 6.0 and its supplements).

Files come through Spark's binary reader; a task turns one file into an Arrow batch for each strip or tile. The first
image of a file is read; ``cog`` reads overviews and frames. Grids are written as a file for each square of nodes.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "path string, row_ long, col long, band int, x double, y double, value double"
# fixed values: letters of the field types, and tag numbers
TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 5: "II", 6: "b", 7: "c", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, SAMPLES, ROWS, STRIP_BYTES, PLANAR, PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES, FORMAT, SCALE, TIE, GEO_KEYS, NO_DATA = 322, 323, 324, 325, 339, 33550, 33922, 34735, 42113


@dataclass(frozen=True)
class Kind:
    """Byte order and widths of a file: TIFF or BigTIFF."""

    order: str
    big: bool

    def directory(self, read: Callable[[int, int], bytes], at: int) -> tuple[dict[int, tuple], int]:
        """The values of the tags of the image whose directory is at a place, and the place of the next one (0: none)."""
        word, entry, room, head = ("Q", 20, 8, 8) if self.big else ("I", 12, 4, 2)
        (count,) = struct.unpack(self.order + ("Q" if self.big else "H"), read(at, head))
        data, out = read(at + head, count * entry + room), {}
        for place in range(0, count * entry, entry):
            tag, kind, n = struct.unpack_from(f"{self.order}HH{word}", data, place)
            if kind in TYPES:
                layout = self.order + TYPES[kind] * n
                size, value = struct.calcsize(layout), place + entry - room
                out[tag] = struct.unpack(layout, data[value : value + size] if size <= room else read(struct.unpack_from(self.order + word, data, value)[0], size))
        return out, struct.unpack_from(self.order + word, data, count * entry)[0]


def opened(read: Callable[[int, int], bytes]) -> tuple[Kind, int]:
    """Of a file given by a function that reads (place, size): its kind and its first directory."""
    start = read(0, 8)
    order = {b"II": "<", b"MM": ">"}.get(bytes(start[:2]))
    version = struct.unpack_from(f"{order}H", start, 2)[0] if order else 0
    if version not in (42, 43):
        raise ValueError("not a TIFF file")
    kind = Kind(order, version == 43)
    return kind, struct.unpack(order + "Q", read(8, 8))[0] if kind.big else struct.unpack_from(order + "I", start, 4)[0]


def tags(data: memoryview) -> tuple[str, dict[int, tuple]]:
    """Byte order and the values of the first image's tags."""
    read = lambda at, size: bytes(data[at : at + size])
    kind, first = opened(read)
    return kind.order, kind.directory(read, first)[0]


def unpack_bits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 2 if n > 128 else 1
    return bytes(out)


def unpack_lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant first; they get a bit longer one code before the table is full."""
    out, last, held, n, width = bytearray(), b"", 0, 0, 9
    table: list[bytes] = []
    for byte in data:
        held, n = held << 8 | byte, n + 8
        if n < width:
            continue
        n -= width
        code, held = held >> n, held & ((1 << n) - 1)
        if code == 257:
            break
        if code == 256:
            table, last, width = [*(bytes([i]) for i in range(256)), b"", b""], b"", 9
            continue
        found = table[code] if code < len(table) else last + last[:1]
        out += found
        if last:
            table.append(last + found[:1])
        last, width = found, min(12, max(9, (len(table) + 1).bit_length()))
    return bytes(out)


def unpacked(data: bytes, compression: int) -> bytes:
    if compression == 1:
        return data
    if compression in (8, 32946):
        return zlib.decompress(data)
    if compression == 5:
        return unpack_lzw(data)
    if compression == 32773:
        return unpack_bits(data)
    raise ValueError(f"TIFF compression {compression}")


def pixels(data: bytes, kind: np.dtype, shape: tuple[int, int, int], predictor: int) -> np.ndarray:
    """Rows, columns, samples of an unpacked strip or tile."""
    rows, cols, samples = shape
    data = data[: rows * cols * samples * kind.itemsize]
    if predictor == 3:  # the bytes of a row stand by weight, each as its difference from the one before
        steps = np.frombuffer(data, np.uint8).reshape(rows, cols * kind.itemsize, samples)
        flat = np.add.accumulate(steps, axis=1, dtype=np.uint8).reshape(rows, kind.itemsize, cols * samples)
        return np.ascontiguousarray(flat.transpose(0, 2, 1)).view(kind.newbyteorder(">")).reshape(shape)
    out = np.frombuffer(data, kind).reshape(shape)
    return np.add.accumulate(out, axis=1, dtype=kind.newbyteorder("=")) if predictor == 2 else out


class Blocks:
    """How an image is cut into strips or tiles: ``starts`` and ``sizes`` are their places in the file."""

    def __init__(self, order: str, t: dict[int, tuple]) -> None:
        if len(set(t.get(BITS, (1,)))) > 1 or t.get(BITS, (1,))[0] not in (8, 16, 32, 64):
            raise ValueError("bits of a sample")
        self.width, self.height, self.samples = t[WIDTH][0], t[HEIGHT][0], t.get(SAMPLES, (1,))[0]
        self.kind = np.dtype(f"{order}{ {1: 'u', 2: 'i', 3: 'f'}[t.get(FORMAT, (1,))[0]]}{t[BITS][0] // 8}")
        self.tiled, self.apart = TILES in t, t.get(PLANAR, (1,))[0] == 2
        self.w, self.h = (t[TILE_WIDTH][0], t[TILE_HEIGHT][0]) if self.tiled else (self.width, min(self.height, t.get(ROWS, (self.height,))[0]))
        self.starts, self.sizes = (t[TILES], t[TILE_BYTES]) if self.tiled else (t[STRIPS], t[STRIP_BYTES])
        self.across, self.down = -(-self.width // self.w), -(-self.height // self.h)
        self.compression, self.predictor = t.get(COMPRESSION, (1,))[0], t.get(PREDICTOR, (1,))[0]

    def place(self, k: int) -> tuple[int, int, int]:
        """First row and column of block k, and its band."""
        band, place = divmod(k, self.across * self.down) if self.apart else (0, k)
        return place // self.across * self.h, place % self.across * self.w, band

    def decoded(self, k: int, data: bytes) -> tuple[int, int, int, np.ndarray]:
        """First row, column and band of block k, and its pixels inside the image."""
        r, c, band = self.place(k)
        rows = self.h if self.tiled else min(self.h, self.height - r)
        made = pixels(unpacked(data, self.compression), self.kind, (rows, self.w, 1 if self.apart else self.samples), self.predictor)
        return r, c, band, made[: self.height - r, : self.width - c]


def blocks(data: memoryview) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """First row, column and band of each strip or tile, and its pixels inside the image; blocks that were never written are left out."""
    cut = Blocks(*tags(data))
    for k, (start, size) in enumerate(zip(cut.starts, cut.sizes, strict=True)):
        if size:
            yield cut.decoded(k, bytes(data[start : start + size]))


def placing(t: dict[int, tuple]) -> tuple[float, float, float, float] | None:
    """x and y of the first pixel's centre and the steps to the next ones; None without them."""
    if SCALE not in t or TIE not in t:
        return None
    (sx, sy), (i, j, _, x, y, _) = t[SCALE][:2], t[TIE][:6]
    keys = t.get(GEO_KEYS, ())
    half = 0.0 if any(keys[k] == 1025 and keys[k + 3] == 2 for k in range(4, len(keys) - 3, 4)) else 0.5  # whether the point is a pixel's corner or its centre
    return x + (half - i) * sx, y - (half - j) * sy, sx, -sy


def _pixels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
            data = memoryview(content.as_buffer())
            _, t = tags(data)
            at = placing(t)
            none = float(b"".join(t[NO_DATA]).strip(b"\0 ")) if NO_DATA in t else None
            for r, c, band, values in blocks(data):
                i, j, s = (a.ravel() for a in np.indices(values.shape))
                flat = values.ravel().astype(float)
                xy = [at[0] + (j + c) * at[2], at[1] + (i + r) * at[3]] if at else [pa.nulls(len(i), pa.float64())] * 2
                missing = np.isnan(flat) | (flat == none if none is not None else False)
                columns = [[path] * len(i), i + r, j + c, (s + band).astype(np.int32), *xy, pa.array(flat, mask=missing)]
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], names=["path", "row_", "col", "band", "x", "y", "value"])


def read_tiff(spark: SparkSession, path: str) -> DataFrame:
    """A row per pixel and band of each *.tif or *.tiff file under ``path``; x and y are the pixel's centre (null without a place), no-data is null."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[tT][iI][fF]*").load(path).select("path", "content")
    return files.mapInArrow(_pixels, SCHEMA)


def file_of(values: np.ndarray, x: float, y: float, gsd: float, none: float) -> bytes:
    """A TIFF file of 32-bit floats in one Deflate strip; x and y are the first pixel's corner."""
    body = zlib.compress(np.where(np.isnan(values), none, values).astype("<f4").tobytes())
    body += b"\0" * (len(body) % 2)
    extra = {SCALE: struct.pack("<3d", gsd, gsd, 0.0), TIE: struct.pack("<6d", 0.0, 0.0, 0.0, x, y, 0.0), NO_DATA: f"{none:.1f}".encode() + b"\0"}
    kinds = {SCALE: (12, 3), TIE: (12, 6), NO_DATA: (2, len(extra[NO_DATA]))}
    plain = {WIDTH: values.shape[1], HEIGHT: values.shape[0], BITS: 32, COMPRESSION: 8, 262: 1, STRIPS: 8, SAMPLES: 1, ROWS: values.shape[0], STRIP_BYTES: len(body), FORMAT: 3}
    entries, at = [(t, 4, 1, v) for t, v in plain.items()], 8 + len(body)
    for tag, raw in extra.items():
        entries.append((tag, *kinds[tag], at))
        at += len(raw)
    table = struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHII", *e) for e in sorted(entries)) + struct.pack("<I", 0)
    return struct.pack("<2sHI", b"II", 42, at) + body + b"".join(extra.values()) + table


def write_tiff(nodes: DataFrame, x0: float, y0: float, gsd: float, side: int = 512, none: float = -9999.0) -> DataFrame:
    """nodes (row_, col, z) of a grid whose first node lies at x0, y0 -> (name, content): a TIFF file for each square of ``side`` nodes that has some.

    A node is a pixel's centre. A square's nodes make one group, side x side at most, so no task holds more however large the
    grid is. Places without a node, and null heights, are no-data; of nodes at one place the highest is taken. The last
    square of a row or column is cut to the nodes that it has.
    """
    square = nodes.where("row_ is not null and col is not null").groupBy("row_", "col").agg(F.max("z").cast("double").alias("z"))
    square = square.select(F.floor(F.col("row_") / side).alias("down"), F.floor(F.col("col") / side).alias("across"), F.col("row_").cast("long"), F.col("col").cast("long"), "z")

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        r, c = rows["row_"] - key[0] * side, rows["col"] - key[1] * side
        values = np.full((r.max() + 1, c.max() + 1), np.nan)
        values[r, c] = rows["z"]
        corner = x0 + (key[1] * side - 0.5) * gsd, y0 - (key[0] * side - 0.5) * gsd
        return pd.DataFrame({"name": [f"{key[0]:06d}-{key[1]:06d}.tif"], "content": [file_of(values, *corner, gsd, none)]})

    return square.groupBy("down", "across").applyInPandas(run, "name string, content binary")
