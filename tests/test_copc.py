import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.functions.geometry import Frame
from geoloom.sources import copc
from geoloom.sources.files import store


def cell_rows(seed: int, name: str) -> list[tuple]:
    """Cells of a pyramid whose parents all exist, five levels deep; some are empty."""
    rng, rows, level = np.random.default_rng(seed), [], [(0, 0, 0)]
    for k in range(6):
        rows += [(name, k, *c, int(rng.integers(1, 500))) for c in level]
        down = [(2 * x + i, 2 * y + j, 2 * z + h) for x, y, z in level for i in (0, 1) for j in (0, 1) for h in (0, 1)]
        level = [c for c in down if rng.random() < 0.3]
    return rows


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("copc")
    rows = cell_rows(1, "a") + cell_rows(2, "b") + [("c", 0, 0, 0, 0, 7)]
    cells = spark.createDataFrame(rows, "name string, level int, x int, y int, z int, point_count int")
    assert store(copc.write_hierarchies(cells, (100.0, 200.0, 0.0), 64.0, 8.0, 2), str(folder)) == 3
    return str(folder), rows


def got(df) -> set:
    return {(r.path.rsplit("/", 1)[1][0], r.level, r.x, r.y, r.z, r.point_count) for r in df.collect()}


def test_all_entries(spark, stored):
    folder, rows = stored
    found = copc.entries(spark, folder)
    assert found.count() == len(rows) and got(found) == set(rows)
    assert got(copc.entries(spark, f"{folder}/a.copc.laz")) == {r for r in rows if r[0] == "a"}
    assert got(copc.entries(spark, f"file://{folder}")) == set(rows)
    r = found.where("level = 0").first()
    assert (r.xmin, r.ymin, r.zmin, r.xmax, r.ymax, r.zmax, r.spacing) == (100, 200, 0, 164, 264, 64, 8)


def test_pruned_as_a_plain_filter(spark, stored):
    folder, _ = stored
    frame = Frame(110.0, 205.0, 121.0, 222.0)
    every = copc.entries(spark, folder)
    plain = every.where((F.col("xmin") <= frame.xmax) & (F.col("xmax") >= frame.xmin) & (F.col("ymin") <= frame.ymax) & (F.col("ymax") >= frame.ymin) & (F.col("spacing") >= 1.0))
    pruned = copc.entries(spark, folder, frame, 1.0)
    assert got(pruned) == got(plain) and 0 < len(got(plain)) < every.count()


def test_pages_out_of_reach_are_not_read(stored, monkeypatch):
    folder, _ = stored
    read, real = [], copc.page_at
    monkeypatch.setattr(copc, "page_at", lambda file, offset, size: read.append(offset) or real(file, offset, size))

    def pages(bounds: str) -> int:
        read.clear()
        reader = copc.Reader({"path": folder, "bounds": bounds})
        for part in reader.partitions():
            list(reader.read(part))
        return len(read)

    whole, none = pages("{}"), pages('{"level": 1}')
    assert none == 2 * 3 < whole  # a root page is read to plan, and again by its task
    assert none < pages('{"xmax": 150.0, "ymax": 250.0}') < whole


def test_pushed_filters(spark, stored):
    folder, rows = stored
    reader = copc.PushedReader({"path": folder})
    some = [copc.LessThan(("level",), 3), copc.GreaterThanOrEqual(("xmax",), 120.0), copc.GreaterThan(("level",), 0), copc.EqualTo(("point_count",), 5)]
    assert list(reader.pushFilters(some)) == some  # all are still to be checked
    assert reader.bounds == {"level": 3, "xmax": 120.0}
    before = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        assert got(copc.entries(spark, folder).where("level <= 2 and xmin < 130")) == {r for r in rows if r[1] <= 2 and 100 + r[2] * 64 / 2 ** r[1] < 130}
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", before)


def test_bytes_of_a_file(tmp_path, spark):
    """Written by hand: two entries, one empty, and one page further down."""
    entry = struct.Struct("<4iQ2i")
    info = struct.pack("<5d2Q2d", 50, 50, 50, 50, 10.0, 589, 4 * 32, 0, 0) + b"\0" * 88
    head = bytearray(429)
    head[:4], head[377:381] = b"LASF", b"copc"
    root = entry.pack(0, 0, 0, 0, 4000, 90, 3) + entry.pack(1, 0, 0, 0, 0, 0, 0) + entry.pack(1, 1, 0, 0, 4090, 30, 1) + entry.pack(1, 1, 1, 0, 589 + 4 * 32, 32, -1)
    (tmp_path / "x.copc.laz").write_bytes(bytes(head) + info + root + entry.pack(2, 2, 3, 0, 4120, 60, 2))
    rows = sorted((r.level, r.x, r.y, r.offset, r.byte_size, r.point_count, r.xmin, r.ymin) for r in copc.entries(spark, str(tmp_path)).collect())
    assert rows == [(0, 0, 0, 4000, 90, 3, 0.0, 0.0), (1, 1, 0, 4090, 30, 1, 50.0, 0.0), (2, 2, 3, 4120, 60, 2, 50.0, 75.0)]
    (tmp_path / "y.copc.laz").write_bytes(bytes(head) + info + root[:40])
    with pytest.raises(Exception, match="cut short"):
        copc.entries(spark, str(tmp_path)).count()


def test_many_files_are_runs_of_whole_files(tmp_path, monkeypatch):
    import pandas as pd

    from geoloom.sources import copc

    rows = pd.DataFrame({"level": [0, 1, 3], "x": [0, 1, 5], "y": [0, 1, 2], "z": [0, 0, 0], "point_count": [5, 4, 3]})
    for k in range(10):
        (tmp_path / f"{k}.copc.laz").write_bytes(copc.hierarchy_of(rows, (0.0, 0.0, 0.0), 1000.0, 100.0, 2))
    reader = copc.Reader({"path": str(tmp_path)})
    read = lambda parts: sorted((r["path"], r["level"], r["x"], r["point_count"]) for p in parts for b in reader.read(p) for r in b.to_pylist())
    planned = reader.partitions()
    monkeypatch.setattr(copc, "PLANNED", 4)
    parts = reader.partitions()
    assert len(parts) == 4 < len(planned) and len(read(parts)) == 30 and read(parts) == read(planned)
