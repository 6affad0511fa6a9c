"""Readers against small files written here byte by byte."""

import json
import struct

import pytest
from pyspark.sql import functions as F

import numpy as np

from geoloom.sources import las, shapefile, text
from geoloom.sources.files import store


def _las(minor: int, kind: int, points: list) -> bytes:
    size = {0: 20, 1: 28, 6: 30}[kind]
    head = bytearray(375)
    head[:4], head[24], head[25], head[104] = b"LASF", 1, minor, kind
    struct.pack_into("<I", head, 96, 375)
    struct.pack_into("<HI", head, 105, size, len(points) if minor < 4 else 0)
    struct.pack_into("<6d", head, 131, 0.01, 0.01, 0.01, 1000.0, 2000.0, 0.0)
    struct.pack_into("<Q", head, 247, len(points) if minor >= 4 else 0)
    body = bytearray(size * len(points))
    for i, (x, y, z, level, cls, t) in enumerate(points):
        struct.pack_into("<3iH", body, i * size, x, y, z, level)
        struct.pack_into("<B", body, i * size + (16 if kind >= 6 else 15), cls)
        if kind:
            struct.pack_into("<d", body, i * size + (22 if kind >= 6 else 20), t)
    return bytes(head + body)


@pytest.mark.parametrize(("minor", "kind"), [(2, 0), (2, 1), (4, 6)])
def test_las(spark, tmp_path, minor, kind):
    points = [(100 * i, 7 * i, -i, i, 2 if kind < 6 else 66, 5.5 + i) for i in range(10)]
    (tmp_path / "a.las").write_bytes(_las(minor, kind, points))
    (tmp_path / "empty.las").write_bytes(_las(minor, kind, []))
    got = las.read_las(spark, str(tmp_path)).orderBy("point").collect()
    assert [(round(r["x"], 6), round(r["y"], 6), round(r["z"], 6), r["intensity"], r["classification"], r["gps_time"]) for r in got] == [
        (1000 + x / 100, round(2000 + y / 100, 6), z / 100, level, cls, t if kind else None) for x, y, z, level, cls, t in points
    ]


def _shp(code: int, contents: list[bytes]) -> bytes:
    body = b"".join(struct.pack(">2i", i, len(c) // 2) + c for i, c in enumerate(contents, 1))
    return struct.pack(">i5ii", 9994, 0, 0, 0, 0, 0, 50 + len(body) // 2) + struct.pack("<2i8d", 1000, code, *[0.0] * 8) + body


def test_shapefile(spark, tmp_path):
    line = struct.pack("<i4d2i2i8d", 3, 0, 0, 9, 9, 2, 4, 0, 2, *map(float, (0, 0, 1, 1, 5, 5, 9, 9)))
    with_z = struct.pack("<i4d2ii4d2d2d", 13, 0, 0, 9, 9, 1, 2, 0, 0, 0, 3, 4, 7, 8, 7, 8)
    (tmp_path / "a.shp").write_bytes(_shp(3, [line, with_z, struct.pack("<i", 0), struct.pack("<i2d", 1, 2.5, 3.5)]))
    fields = b"".join(struct.pack("<11sc4xBB14x", n, b"C", w, 0) for n, w in ((b"NAME", 6), (b"N", 3)))
    rows = b" Stra\xdfe  1" + b"*gone    2" + b"           "[:10] + b" x       4"
    (tmp_path / "a.dbf").write_bytes(struct.pack("<BBBBIHH20x", 3, 1, 1, 1, 4, 32 + len(fields) + 1, 10) + fields + b"\r" + rows)
    got = shapefile.read_shapefile(spark, str(tmp_path)).orderBy("record").collect()
    assert [(r["kind"], r["parts"], [tuple(p) for p in r["pts"]]) for r in got] == [
        ("line", [0, 2], [(0, 0, None), (1, 1, None), (5, 5, None), (9, 9, None)]), ("line", [0], [(0, 0, 7), (3, 4, 8)]), ("null", [], []), ("point", [0], [(2.5, 3.5, None)]),
    ]
    assert [r["attributes"] for r in got] == [{"NAME": "Straße", "N": "1"}, {}, {"NAME": "", "N": ""}, {"NAME": "x", "N": "4"}]
    parts = shapefile.parts_of(shapefile.read_shapefile(spark, str(tmp_path)).where("record = 1")).orderBy("part").collect()
    assert [[p["x"] for p in r["pts"]] for r in parts] == [[0, 1], [5, 9]]


def test_geojson(spark, tmp_path):
    features = [{"type": "Feature", "geometry": {"type": "LineString", "coordinates": [[2.5, 48], [3, 49.25]]}, "properties": {"name": "a"}}, {"type": "Feature", "geometry": {"type": "Point", "coordinates": [700000, 6600000]}, "properties": {}}]
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}, indent=1))
    got = text.read_geojson(spark, str(tmp_path)).orderBy("feature").collect()
    assert [(r["kind"], json.loads(r["coordinates"]), r["properties"], r["geographic"]) for r in got] == [("LineString", [[2.5, 48], [3, 49.25]], {"name": "a"}, True), ("Point", [700000, 6600000], {}, True)]
    written = spark.range(1).select(text.geojson_feature(F.lit("Point"), F.array(F.lit(1.5), F.lit(2.0)), F.create_map(F.lit("k"), F.lit("v"))).alias("f")).first()["f"]
    assert json.loads(written) == {"type": "Feature", "geometry": {"type": "Point", "coordinates": [1.5, 2.0]}, "properties": {"k": "v"}}


def test_points_and_grid(spark, tmp_path):
    (tmp_path / "p.csv").write_text("made by hand\nid;x;y;z\n1;2.5;3;4\n2;5;6;\n3;bad;1;1\n")
    got = text.read_points(spark, str(tmp_path / "p.csv"), 1, 2, 3, skip=2).orderBy("x").collect()
    assert [tuple(r) for r in got] == [(2.5, 3, 4), (5, 6, None)]
    (tmp_path / "g.asc").write_text("ncols 3\nnrows 2\nxllcorner 100\nyllcorner 200\ncellsize 10\nNODATA_value -9999\n1 2 3\n4 -9999 6.5\n")
    got = text.read_asc(spark, str(tmp_path / "g.asc")).orderBy("row_", "col").collect()
    assert [tuple(r)[1:] for r in got] == [(0, 0, 105, 215, 1), (0, 1, 115, 215, 2), (0, 2, 125, 215, 3), (1, 0, 105, 205, 4), (1, 1, 115, 205, None), (1, 2, 125, 205, 6.5)]


def test_las_cut_short(spark, tmp_path):
    (tmp_path / "a.las").write_bytes(_las(2, 0, [(1, 2, 3, 4, 5, 6)] * 3)[:-1])
    with pytest.raises(Exception, match="cut short"):
        las.read_las(spark, str(tmp_path)).count()


def test_stored_files(spark, tmp_path):
    rows = [("a.bin", b"one"), ("b.bin", b""), ("a.bin", b"one")]  # a name twice, as when a task runs twice
    assert store(spark.createDataFrame(rows, "name string, content binary"), str(tmp_path / "new" / "folder")) == 3
    assert {p.name: p.read_bytes() for p in (tmp_path / "new" / "folder").iterdir() if p.suffix == ".bin" and p.name[0] != "."} == {"a.bin": b"one", "b.bin": b""}


def test_las_file_grows_by_batches_and_is_held_once():
    import tracemalloc

    n, step = 400_000, 10_000
    rng = np.random.default_rng(7)
    xyz = {c: np.round(rng.uniform(-500, 500, n), 2) for c in "xyz"}
    rest = {"intensity": np.arange(n) % 900, "classification": np.arange(n) % 7, "gps_time": np.arange(n) / 8}
    tracemalloc.start()
    file = las.Growing(0.01)
    for at in range(0, n, step):
        file.add({c: v[at : at + step] for c, v in (xyz | rest).items()})
    data = file.content()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    h = las.header(bytes(data[: las.HEADER]))
    p = np.frombuffer(data, las.layout(h["format"], h["size"]), h["count"], h["start"])
    assert h["count"] == n and most < 2.5 * len(data)
    assert all(np.abs(p[c] * s + o - xyz[c]).max() < 1e-6 for c, s, o in zip("xyz", h["scale"], h["offset"], strict=True))
