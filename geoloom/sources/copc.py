"""Cloud-optimised point clouds (COPC 1.0): their hierarchy of cells as a data source.

A file's entries stand in pages of 32 bytes each; an entry with a point count of -1 names a further page, with zero it is empty. The source
plans a partition for the root page of each file and one for each page that the root names; a task walks down from its page. Of more
than PLANNED files a partition is a run of files, so partitions do not grow with them. A page
is only read if its cell may hold entries that are asked for: a cell below is never larger, coarser or further out, so upper
bounds of level, xmin, ymin, zmin and lower bounds of xmax, ymax, zmax, spacing hold for all pages below. Such bounds come from the
frame and the ground resolution given to ``entries``, and from pushed filters where Spark hands them over
(``spark.sql.python.filterPushdown.enabled``). Ranges of the file are read, never the whole of it.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from geoloom.functions.geometry import Frame
from geoloom.sources.files import place

# fixed values: the format's layout
INFO_AT, INFO = 375 + 54, struct.Struct("<5d2Q2d")  # centre, half size, spacing, root page's place and size, ends of the GPS time
ENTRY = np.dtype([("level", "<i4"), ("x", "<i4"), ("y", "<i4"), ("z", "<i4"), ("offset", "<u8"), ("size", "<i4"), ("count", "<i4")])
SCHEMA = "path string, level int, x int, y int, z int, offset long, byte_size int, point_count int, xmin double, ymin double, zmin double, xmax double, ymax double, zmax double, spacing double"
UPPER, LOWER = ("level", "xmin", "ymin", "zmin"), ("xmax", "ymax", "zmax", "spacing")
PLANNED = 1000  # with more files than this, a partition is a run of whole files, of which there are so many at most


@dataclass(frozen=True)
class Cube:
    """A file's root cell."""

    low: tuple[float, float, float]
    side: float
    spacing: float

    def columns(self, e: np.ndarray) -> dict[str, np.ndarray]:
        scale = np.exp2(e["level"].astype(float))
        side = self.side / scale
        low = {f"{c}min": self.low[i] + e[c] * side for i, c in enumerate("xyz")}
        return {"level": e["level"]} | low | {f"{c}max": self.low[i] + (e[c].astype(float) + 1) * side for i, c in enumerate("xyz")} | {"spacing": self.spacing / scale}


def _opened(path: str):
    system, at = place(path)
    return system.open_input_file(at)


def root_of(file) -> tuple[Cube, int, int]:
    """Of an open file: its cube, the root page's place and size."""
    file.seek(0)
    data = file.read(INFO_AT + INFO.size)
    if data[:4] != b"LASF" or len(data) < INFO_AT + INFO.size or data[377:381] != b"copc":
        raise ValueError("not a COPC file")
    cx, cy, cz, half, spacing, offset, size, _, _ = INFO.unpack_from(data, INFO_AT)
    return Cube((cx - half, cy - half, cz - half), 2 * half, spacing), offset, size


def page_at(file, offset: int, size: int) -> np.ndarray:
    file.seek(offset)
    data = file.read(size)
    if len(data) < size or size % ENTRY.itemsize:
        raise ValueError("a hierarchy page is cut short")
    return np.frombuffer(data, ENTRY)


def wanted(columns: dict[str, np.ndarray], bounds: dict[str, float]) -> np.ndarray:
    """Whether entries, or any below them, may be within the bounds."""
    out = np.ones(len(columns["level"]), bool)
    for name, end in bounds.items():
        out &= columns[name] <= end if name in UPPER else columns[name] >= end
    return out


@dataclass
class Page(InputPartition):
    path: str
    offset: int
    size: int
    deep: bool  # with the pages below


@dataclass
class Files(InputPartition):
    paths: list[str]


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.bounds = options["path"], json.loads(options.get("bounds", "{}"))

    def files(self) -> list[str]:
        system, at = place(self.path)
        if system.get_file_info(at).type == fs.FileType.File:
            return [self.path]
        prefix = self.path[: len(self.path) - len(at)] if self.path.endswith(at) else ""
        return sorted(prefix + x.path for x in system.get_file_info(fs.FileSelector(at, recursive=True)) if x.path.lower().endswith(".copc.laz"))

    def partitions(self) -> Sequence[InputPartition]:
        files = self.files()
        if len(files) > PLANNED:
            each = -(-len(files) // PLANNED)
            return [Files(files[i : i + each]) for i in range(0, len(files), each)]
        out: list[InputPartition] = []
        for path in files:
            with _opened(path) as file:
                cube, offset, size = root_of(file)
                out.append(Page(path, offset, size, False))
                below = page_at(file, offset, size)
                below = below[(below["count"] < 0) & wanted(cube.columns(below), self.bounds)]
                out += [Page(path, int(e["offset"]), int(e["size"]), True) for e in below]
        return out

    def read(self, part: InputPartition) -> Iterator[pa.RecordBatch]:
        for page in [Page(f, -1, 0, True) for f in part.paths] if isinstance(part, Files) else [part] if isinstance(part, Page) else []:
            yield from self._page(page)

    def _page(self, part: Page) -> Iterator[pa.RecordBatch]:
        with _opened(part.path) as file:
            cube, offset, size = root_of(file)
            todo = [(offset, size) if part.offset < 0 else (part.offset, part.size)]
            while todo:
                entries = page_at(file, *todo.pop())
                columns = cube.columns(entries)
                here = wanted(columns, self.bounds)
                if part.deep:
                    todo += [(int(e["offset"]), int(e["size"])) for e in entries[here & (entries["count"] < 0)]]
                here &= entries["count"] > 0
                e = entries[here]
                made = {c: v[here] for c, v in columns.items()}
                own = {"x": e["x"], "y": e["y"], "z": e["z"], "offset": e["offset"].astype(np.int64), "byte_size": e["size"], "point_count": e["count"]}
                named = made | own
                names = [c.split()[0] for c in SCHEMA.split(", ")][1:]
                yield pa.RecordBatch.from_arrays([pa.array([part.path] * len(e), pa.string()), *(pa.array(np.ascontiguousarray(named[c])) for c in names)], names=["path", *names])


class PushedReader(Reader):
    """For sessions that hand filters over; Spark refuses such a reader in others."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds that hold for whole subtrees are taken; all filters still run afterwards, on what is left."""
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else ""
            if name in UPPER and isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                self.bounds[name] = min(f.value, self.bounds.get(name, f.value))
            if name in LOWER and isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                self.bounds[name] = max(f.value, self.bounds.get(name, f.value))
            yield f


class CopcEntries(DataSource):
    """Entries with points of *.copc.laz files under ``path``."""

    @classmethod
    def name(cls) -> str:
        return "copc_entries"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return (PushedReader if self.options.get("pushed") == "true" else Reader)(dict(self.options))


def entries(spark: SparkSession, path: str, frame: Frame | None = None, gsd: float | None = None) -> DataFrame:
    """A row per entry that has points: cell, place in the file, frame, spacing. With ``frame`` cells that meet it, with ``gsd`` levels whose points are at least that far apart."""
    spark.dataSource.register(CopcEntries)
    bounds = {"xmin": frame.xmax, "xmax": frame.xmin, "ymin": frame.ymax, "ymax": frame.ymin} if frame else {}
    if gsd is not None:
        bounds["spacing"] = gsd
    pushed = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    return spark.read.format("copc_entries").option("bounds", json.dumps(bounds)).option("pushed", pushed).load(path)


def hierarchy_of(group: pd.DataFrame, low: tuple[float, float, float], side: float, spacing: float, depth: int) -> bytes:
    """Header and pages of a file for entries (level, x, y, z, point_count): cells ``depth`` levels below a page's own go to further pages.

    Points are not written (their places are those that 30 bytes a point would have): the file serves to plan reading.
    """
    rows = group.sort_values(["level", "x", "y", "z"])
    e = np.zeros(len(rows), ENTRY)
    for c in ("level", "x", "y", "z"):
        e[c] = rows[c]
    e["count"], e["size"] = rows["point_count"], rows["point_count"] * 30
    start = INFO_AT + 160
    e["offset"] = start + np.cumsum(e["size"].astype(np.int64)) - e["size"]
    at = int(start + e["size"].astype(np.int64).sum())
    pages: list[bytes] = []

    def page(mine: np.ndarray, level: int) -> tuple[int, int]:
        """Write the page of these entries, those further down in pages of their own before it; its place and size."""
        nonlocal at
        own, down = mine[mine["level"] < level + depth], mine[mine["level"] >= level + depth]
        shift = down["level"] - (level + depth)
        keys = np.stack([down[c] >> shift for c in "xyz"], axis=1)
        named = []
        for key in np.unique(keys, axis=0) if len(down) else ():
            offset, size = page(down[(keys == key).all(axis=1)], level + depth)
            named.append((level + depth, *key, offset, size, -1))
        data = np.concatenate([own, np.array(named, ENTRY)]) if named else own
        pages.append(data.tobytes())
        at += len(pages[-1])
        return at - len(pages[-1]), len(pages[-1])

    offset, size = page(e, 0)
    head = bytearray(start)
    head[:4], head[24], head[25], head[104] = b"LASF", 1, 4, 0x80 | 6
    struct.pack_into("<HII", head, 94, 375, start, 1)
    struct.pack_into("<H16sHH", head, 375, 0, b"copc", 1, 160)
    INFO.pack_into(head, INFO_AT, *(v + side / 2 for v in low), side / 2, spacing, offset, size, 0.0, 0.0)
    return bytes(head) + b"\0" * int(e["size"].astype(np.int64).sum()) + b"".join(pages)


def write_hierarchies(cells: DataFrame, low: tuple[float, float, float], side: float, spacing: float, depth: int = 3) -> DataFrame:
    """cells (name, level, x, y, z, point_count) -> (name, content): a file for each name; its cells are one group."""

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"name": [f"{key[0]}.copc.laz"], "content": [hierarchy_of(group, low, side, spacing, depth)]})

    return cells.select(F.col("name").cast("string"), "level", "x", "y", "z", "point_count").groupBy("name").applyInPandas(run, "name string, content binary")
