"""GeoPackages, well-known binary and written shapefiles: small files made here, and round trips."""

import sqlite3
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from geoloom.sources import geopackage, shapefile, wkb

Z = float("nan")


def _blob(code: int, order: str, body: bytes, pts: np.ndarray) -> bytes:
    x, y, z = pts[:, 0], pts[:, 1], pts[:, 2]
    numbers = {0: (), 1: (x.min(), x.max(), y.min(), y.max())}
    numbers[2] = numbers[3] = (*numbers[1], z.min(), z.max())
    numbers[4] = (*numbers[2], 0.0, 1.0)
    return b"GP" + bytes([0, code << 1 | (order == "<")]) + struct.pack(f"{order}i{len(numbers[code])}d", 2154, *numbers[code]) + body


@pytest.mark.parametrize("code", range(5))
@pytest.mark.parametrize("order", ["<", ">"])
def test_headers(code, order):
    pts = np.array([[1.0, 5.0, 7.0], [2.0, 3.0, 9.0]])
    body = wkb.encode("line", [0], pts)
    srs, frame, rest = geopackage.header(_blob(code, order, body, pts))
    assert srs == 2154 and rest == body and (frame == [] if code == 0 else frame[:4] == [1, 3, 2, 5])
    assert code not in (2, 4) or frame[4:] == [7, 9]


def test_bad_headers():
    for blob in (b"XP\0\0" + bytes(8), b"GX\0\0" + bytes(8), b"GP\0\x0a" + bytes(80)):
        with pytest.raises(ValueError):
            geopackage.header(blob)


@settings(max_examples=60, deadline=None)
@given(st.sampled_from(["point", "line", "polygon", "multipoint", "multiline", "multipolygon"]), st.lists(st.integers(1, 5), min_size=1, max_size=4), st.booleans())
def test_wkb_round_trip(kind, sizes, with_z):
    sizes = [1] if kind == "point" else [1] * len(sizes) if kind == "multipoint" else sizes[:1] if kind == "line" else sizes
    pts = np.arange(3.0 * sum(sizes)).reshape(-1, 3)
    if not with_z:
        pts[:, 2] = np.nan
    parts = np.cumsum([0, *sizes])[:-1].tolist()
    got = wkb.decode(wkb.encode(kind, parts, pts))
    assert got[0] == kind and got[1] == parts and np.array_equal(got[2], pts, equal_nan=True)


def test_wkb_forms():
    assert np.array_equal(wkb.decode(struct.pack(">BI2d", 0, 1, 3.0, 4.0))[2], [[3, 4, Z]], equal_nan=True)
    assert wkb.decode(struct.pack("<BI4d", 1, 3001, 3.0, 4.0, 5.0, 6.0))[2].tolist() == [[3, 4, 5]]
    assert np.array_equal(wkb.decode(struct.pack("<BI3d", 1, 2001, 3.0, 4.0, 6.0))[2], [[3, 4, Z]], equal_nan=True)
    assert wkb.decode(struct.pack("<BI3d", 1, 0x80000001, 3.0, 4.0, 5.0))[2].tolist() == [[3, 4, 5]]
    assert wkb.decode(struct.pack("<BII", 1, 7, 0)) [:2] == ("collection", []) and wkb.decode(struct.pack("<BI2d", 1, 1, Z, Z))[1] == []
    with pytest.raises(ValueError):
        wkb.decode(struct.pack("<BI2d", 2, 1, 3.0, 4.0))


def test_geopackage(spark, tmp_path):
    base = sqlite3.connect(tmp_path / "a.gpkg")
    base.execute("CREATE TABLE gpkg_contents (table_name, data_type)")
    base.execute("CREATE TABLE gpkg_geometry_columns (table_name, column_name)")
    base.execute("INSERT INTO gpkg_contents VALUES ('roads', 'features'), ('tiles', 'tiles')")
    base.execute("INSERT INTO gpkg_geometry_columns VALUES ('roads', 'geom')")
    base.execute("CREATE TABLE roads (fid INTEGER PRIMARY KEY, geom BLOB, name TEXT, lanes INTEGER)")
    line = np.array([[1.0, 2.0, 3.0], [4.0, 6.0, 5.0]])
    for fid, code in enumerate((0, 1, 2), 1):
        base.execute("INSERT INTO roads VALUES (?, ?, ?, ?)", (fid, _blob(code, "<", wkb.encode("line", [0], line), line), f"é{fid}", None if fid == 2 else fid))
    base.execute("INSERT INTO roads VALUES (9, NULL, NULL, 1)")
    base.commit()
    base.close()
    got = geopackage.read_geopackage(spark, str(tmp_path)).orderBy("fid").collect()
    assert [r["fid"] for r in got] == [1, 2, 3, 9] and {r["layer"] for r in got} == {"roads"}
    assert [(r["xmin"], r["ymin"], r["xmax"], r["ymax"]) for r in got] == [(1, 2, 4, 6)] * 3 + [(None,) * 4] and [r["zmax"] for r in got] == [5, None, 5, None]
    assert got[0]["attributes"] == {"name": "é1", "lanes": "1"} and got[1]["attributes"] == {"name": "é2"} and got[3]["kind"] is None
    assert [(p["x"], p["y"], p["z"]) for p in got[0]["pts"]] == [(1, 2, 3), (4, 6, 5)]


def test_shapefiles_round_trip(spark, tmp_path):
    rows = [
        ("point", [0], [(1.0, 2.0, None)], {"name": "a", "a very long name": "x"}), ("line", [0, 2], [(0.0, 0.0, 1.0), (1.0, 1.0, 2.0), (5.0, 5.0, 3.0), (6.0, 7.0, 4.0)], {"name": "é"}),
        ("polygon", [0], [(0.0, 0.0, None), (0.0, 1.0, None), (1.0, 1.0, None), (0.0, 0.0, None)], {}), ("multipoint", [0], [(3.0, 4.0, None), (5.0, 6.0, None)], None), ("point", [0], [(8.0, 9.0, None)], {"name": ""}),
    ]
    frame = spark.createDataFrame(rows, "kind string, parts array<int>, pts array<struct<x:double,y:double,z:double>>, attributes map<string,string>").coalesce(1)
    files = shapefile.write_shapefiles(frame).collect()
    for f in files:
        (tmp_path / f["name"]).write_bytes(f["content"])
    got = shapefile.read_shapefile(spark, str(tmp_path)).collect()
    plain = lambda kind, parts, pts: (kind, tuple(parts), tuple((p[0], p[1], p[2]) for p in pts))
    assert sorted(map(repr, (plain(r["kind"], r["parts"], [(p["x"], p["y"], p["z"]) for p in r["pts"]]) for r in got))) == sorted(repr(plain(*r[:3])) for r in rows)
    assert {r["attributes"].get("name") for r in got if r["kind"] == "line"} == {"é"}
    assert any(r["attributes"] == {"name": "a", "a very lon": "x"} for r in got)
    for f in files:
        if f["name"].endswith("shx"):
            shp = next(g["content"] for g in files if g["name"] == f["name"][:-1] + "p")
            for place, size in np.frombuffer(f["content"][100:], ">i4").reshape(-1, 2):
                assert struct.unpack_from(">i", shp, 2 * place + 4)[0] == size
    assert shapefile.write_shapefiles(frame.where("false")).count() == 0


def test_from_wkb(spark):
    line = wkb.encode("line", [0], np.array([[1.0, 2, 3], [4, 5, 6]]))
    flat = wkb.encode("polygon", [0, 3], np.array([[0.0, 0, np.nan], [1, 0, np.nan], [0, 0, np.nan], [5, 5, np.nan], [6, 5, np.nan], [5, 5, np.nan]]))
    rows = spark.createDataFrame([(1, line, "own"), (2, flat, None), (3, None, "x")], "id int, g binary, KIND string")
    out = wkb.from_wkb(rows, "g").orderBy("id")
    assert out.columns == ["id", "g", "KIND", "kind_", "parts", "pts"] and rows.columns == ["id", "g", "KIND"]
    got = [(r["KIND"], r["kind_"], r["parts"], None if r["pts"] is None else [tuple(p) for p in r["pts"]]) for r in out.collect()]
    assert got[0] == ("own", "line", [0], [(1, 2, 3), (4, 5, 6)]) and got[2] == ("x", None, None, None)
    assert got[1][1:3] == ("polygon", [0, 3]) and got[1][3][3] == (5, 5, None)


def test_a_set_of_shapes_is_closed_when_it_is_full(spark, tmp_path):
    from geoloom.sources.files import store

    n = 120_003
    point = ["'point' AS kind", "array(0) AS parts", "array(named_struct('x', CAST(id AS DOUBLE), 'y', 1e0, 'z', 2e0)) AS pts", "map('id', CAST(id AS STRING)) AS attributes"]
    files = shapefile.write_shapefiles(spark.range(0, n, 1, 1).selectExpr(*point))
    assert files.count() == 9
    store(files, str(tmp_path))
    back = shapefile.read_shapefile(spark, str(tmp_path)).selectExpr("count(*)", "count(DISTINCT attributes['id'])", "count_if(CAST(pts[0].x AS BIGINT) = CAST(attributes['id'] AS BIGINT))").first()
    assert tuple(back) == (n, n, n)
