"""Drawings and rasters against files written here."""

import struct
import zlib

import numpy as np
import pytest

from geoloom.sources import drawings, las, text, tiff

MIF = """Version 300
Charset "WindowsLatin1"
Delimiter ","
CoordSys Earth Projection 1, 0
Columns 2
  name Char(20)
  size Integer
Data

Point 10.5 -2
    Symbol (34,0,12)
Line 0 0 3 4
    Pen (1,2,0)
Pline 3
1 1
2 2
3 1.5e1
    Pen (1,2,0)
Pline Multiple 2
  2
0 0
1 1
  3
5 5
6 6
7 7
Region  2
  4
0 0
0 9
9 9
0 0
  3
1 1
1 2
2 2
    Brush (1,0,16777215)
    Center 4 4
None
"""
MID = '"a, b",1\n"c",2\nd,3\n"e",\nf,5\n"g",6\n'


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_mif(spark, tmp_path, end):
    (tmp_path / "roads.mif").write_bytes(MIF.replace("\n", end).encode())
    (tmp_path / "roads.MID").write_bytes(MID.replace("\n", end).encode())
    (tmp_path / "bare.mif").write_bytes(b"Version 300\nColumns 1\n a Integer\nData\nPoint 1 2\n")
    got = [r for r in drawings.read_mif(spark, str(tmp_path)).orderBy("path", "object").collect()]
    bare, rows = got[0], got[1:]
    assert bare["attributes"] is None and [tuple(p) for p in bare["parts"][0]] == [(1, 2)]
    assert [r["kind"] for r in rows] == ["point", "line", "pline", "pline", "region", "none"]
    parts = [[[tuple(p) for p in part] for part in r["parts"]] for r in rows]
    assert parts == [[[(10.5, -2)]], [[(0, 0), (3, 4)]], [[(1, 1), (2, 2), (3, 15)]], [[(0, 0), (1, 1)], [(5, 5), (6, 6), (7, 7)]], [[(0, 0), (0, 9), (9, 9), (0, 0)], [(1, 1), (1, 2), (2, 2)]], []]
    assert [(r["attributes"]["name"], r["attributes"]["size"]) for r in rows] == [("a, b", "1"), ("c", "2"), ("d", "3"), ("e", ""), ("f", "5"), ("g", "6")]


def test_dxf(spark, tmp_path):
    polyline = [(0, "POLYLINE"), (8, "walls"), (70, 1), (10, 0), (20, 0)]
    for x, y in ((0, 0), (4, 0), (4, 3)):
        polyline += [(0, "VERTEX"), (8, "other"), (10, x), (20, y), (30, 7), (70, 32)]
    pairs = [
        (0, "SECTION"), (2, "BLOCKS"), (0, "LINE"), (8, "no"), (10, 1), (20, 1), (11, 2), (21, 2), (0, "ENDSEC"), (0, "SECTION"), (2, "ENTITIES"), (0, "LINE"), (8, "roads"), (10, 1.5), (20, 2), (30, 0), (11, 3), (21, 4), (31, 9),
        *polyline, (0, "SEQEND"), (0, "TEXT"), (8, "names"), (10, 5), (20, 6), (11, 8), (21, 8), (1, "Hill 0"), (0, "LWPOLYLINE"), (8, "roads"), (70, 0), (10, 0), (20, 1), (10, 2), (20, 3), (0, "CIRCLE"), (10, 0), (20, 0), (0, "ENDSEC"), (0, "EOF"),
    ]
    (tmp_path / "a.dxf").write_text("".join(f"{c:>3}\n{v}\n" for c, v in pairs))
    (tmp_path / "empty.dxf").write_text("")
    rows = drawings.read_dxf(spark, str(tmp_path)).orderBy("feature").collect()
    assert [(r["kind"], r["layer"], r["text"], r["closed"], [tuple(v) for v in r["vertices"]]) for r in rows] == [
        ("LINE", "roads", None, False, [(1.5, 2, 0), (3, 4, 9)]),
        ("POLYLINE", "walls", None, True, [(0, 0, 7), (4, 0, 7), (4, 3, 7), (0, 0, 7)]),
        ("TEXT", "names", "Hill 0", False, [(5, 6, None)]),
        ("LWPOLYLINE", "roads", None, False, [(0, 1, None), (2, 3, None)]),
    ]


def test_dxf_heights(spark, tmp_path):
    """A vertex without height has none, or its line's elevation; the next one's is not taken."""
    polyline = [(0, "POLYLINE"), (70, 0), (10, 0), (20, 0), (0, "VERTEX"), (10, 1), (20, 1), (0, "VERTEX"), (10, 2), (20, 2), (30, 77), (0, "SEQEND")]
    flat = [(0, "LWPOLYLINE"), (38, 12.5), (70, 0), (10, 0), (20, 1), (10, 2), (20, 3)]
    pairs = [(0, "SECTION"), (2, "ENTITIES"), *polyline, *flat, (0, "ENDSEC"), (0, "EOF")]
    (tmp_path / "a.dxf").write_text("".join(f"{c:>3}\n{v}\n" for c, v in pairs))
    rows = drawings.read_dxf(spark, str(tmp_path)).orderBy("feature").collect()
    assert [[tuple(v) for v in r["vertices"]] for r in rows] == [[(1, 1, None), (2, 2, 77)], [(0, 1, 12.5), (2, 3, 12.5)]]


def test_world(spark, tmp_path):
    (tmp_path / "a.tfw").write_text("0.5\n0\n0\n-0.5\n1000.25\n1999.75\n")
    (tmp_path / "b.tfw").write_text("0.5\n0\n")
    assert [tuple(r)[1:] for r in drawings.read_world(spark, str(tmp_path)).collect()] == [(0.5, 0.5, 1000.0, 2000.0)]


def test_capabilities(spark, tmp_path):
    matrix = lambda i, s: f"<TileMatrix><ows:Identifier>{i}</ows:Identifier><ScaleDenominator>{s}</ScaleDenominator><TopLeftCorner>0 9</TopLeftCorner><TileWidth>256</TileWidth><TileHeight>256</TileHeight></TileMatrix>"
    layer = lambda i, *s: f"<Layer><ows:Identifier>{i}</ows:Identifier><Format>image/png</Format>{''.join(f'<TileMatrixSetLink><TileMatrixSet>{x}</TileMatrixSet></TileMatrixSetLink>' for x in s)}</Layer>"
    sets = f"<TileMatrixSet><ows:Identifier>PM</ows:Identifier><ows:SupportedCRS>EPSG:3857</ows:SupportedCRS>{matrix('0', '559082264.02')}{matrix('1', '279541132.01')}</TileMatrixSet>"
    (tmp_path / "c.xml").write_text(f'<Capabilities xmlns="http://a" xmlns:ows="http://b"><Contents>{layer("photos", "PM")}{layer("maps", "PM", "gone")}{sets}</Contents></Capabilities>')
    rows = drawings.read_capabilities(spark, str(tmp_path)).orderBy("layer", "matrix").collect()
    assert [(r["layer"], r["crs"], r["matrix"], r["scale"], r["tile_width"]) for r in rows] == [(n, "EPSG:3857", m, s, 256) for n in ("maps", "photos") for m, s in (("0", 559082264.02), ("1", 279541132.01))]


def _tiff(values: np.ndarray, order: str, big: bool, tile: tuple[int, int] | None, pack, compression: int, predictor: int) -> bytes:
    height, width, samples = values.shape
    h, w = tile or (2, width)
    kind = values.dtype.newbyteorder(order)
    made = []
    for r in range(0, height, h):
        for c in range(0, width, w):
            part = values[r : r + h, c : c + w]
            if tile:
                part = np.pad(part, ((0, h - part.shape[0]), (0, w - part.shape[1]), (0, 0)))
            if predictor == 2:
                part = np.concatenate([part[:, :1], np.diff(part, axis=1)], axis=1)
            raw = part.astype(kind).tobytes()
            if predictor == 3:
                rows = np.frombuffer(part.astype(values.dtype.newbyteorder(">")).tobytes(), np.uint8).reshape(part.shape[0], -1, kind.itemsize).transpose(0, 2, 1).reshape(part.shape[0], -1, samples)
                raw = np.concatenate([rows[:, :1], np.diff(rows, axis=1)], axis=1).astype(np.uint8).tobytes()
            made.append(pack(raw))
    word, size = ("Q", 16) if big else ("I", 8)
    body, starts = b"", []
    for m in made:
        starts.append(size + len(body))
        body += m
    entries = [(256, "H", [width]), (257, "H", [height]), (258, "H", [kind.itemsize * 8] * samples), (259, "H", [compression]), (277, "H", [samples]), (317, "H", [predictor]), (339, "H", [{"u": 1, "i": 2, "f": 3}[kind.kind]] * samples)]
    entries += [(322, "H", [w]), (323, "H", [h]), (324, word, starts), (325, word, [len(m) for m in made])] if tile else [(273, word, starts), (278, "H", [h]), (279, word, [len(m) for m in made])]
    entries += [(33550, "d", [10.0, 10.0, 0.0]), (33922, "d", [0.0, 0, 0, 1000, 2000, 0]), (42113, "s", [b"7\0"])]
    ids, room = {"H": 3, "I": 4, "Q": 16, "d": 12, "s": 2}, 8 if big else 4
    table, place = b"", size + len(body)
    for tag, letter, v in sorted(entries):
        raw = v[0] if letter == "s" else struct.pack(f"{order}{len(v)}{letter}", *v)
        count = len(raw) if letter == "s" else len(v)
        if len(raw) > room:
            body, at = body + raw, place
            place += len(raw)
            raw = struct.pack(order + word, at)
        table += struct.pack(f"{order}HH{word}", tag, ids[letter], count) + raw.ljust(room, b"\0")
    mark = b"II" if order == "<" else b"MM"
    head = mark + (struct.pack(f"{order}HHHQ", 43, 8, 0, place) if big else struct.pack(f"{order}HI", 42, place))
    return head + body + struct.pack(order + ("Q" if big else "H"), len(entries)) + table + b"\0" * 8


def _bits(raw: bytes) -> bytes:
    return b"".join(bytes([len(raw[i : i + 100]) - 1]) + raw[i : i + 100] for i in range(0, len(raw), 100)) + b"\x80"


def _lzw(raw: bytes) -> bytes:
    out, size, held, known = f"{256:09b}", 258, b"", {bytes([i]): i for i in range(256)}
    long = lambda n: max(9, n.bit_length())  # noqa: E731  (the reader's table is one entry behind)
    for byte in raw:
        more = held + bytes([byte])
        if more in known:
            held = more
            continue
        out += f"{known[held]:0{long(size)}b}"
        known[more], held, size = size, bytes([byte]), size + 1
    return _packed(out + f"{known[held]:0{long(size)}b}" + f"{257:0{long(size + 1)}b}")


def _packed(bits: str) -> bytes:
    n = -(-len(bits) // 8)
    return int(bits.ljust(n * 8, "0"), 2).to_bytes(n, "big")


@pytest.mark.parametrize(
    ("kind", "order", "big", "tile", "pack", "compression", "predictor"),
    [("u1", "<", False, None, bytes, 1, 1), ("f4", ">", False, (4, 4), zlib.compress, 8, 3), ("i2", "<", True, None, zlib.compress, 32946, 2), ("u2", ">", False, (2, 4), _bits, 32773, 2), ("f8", "<", True, (4, 2), bytes, 1, 1), ("u1", "<", False, None, _lzw, 5, 2)],
)
def test_tiff(spark, tmp_path, kind, order, big, tile, pack, compression, predictor):
    values = (np.arange(5 * 7 * 2).reshape(5, 7, 2) * 3 % 101).astype(kind)
    (tmp_path / "a.tif").write_bytes(_tiff(values, order, big, tile, pack, compression, predictor))
    got = {(r["row_"], r["col"], r["band"]): (r["x"], r["y"], r["value"]) for r in tiff.read_tiff(spark, str(tmp_path)).collect()}
    assert got == {(i, j, s): (1005.0 + 10 * j, 1995.0 - 10 * i, None if values[i, j, s] == 7 else float(values[i, j, s])) for i in range(5) for j in range(7) for s in range(2)}


def test_lzw_of_the_specification():
    assert tiff.unpack_lzw(_packed("".join(f"{c:09b}" for c in (256, 7, 258, 8, 8, 258, 6, 6, 257)))) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])


def test_lzw_grows_its_codes():
    raw = bytes(np.random.default_rng(1).integers(0, 200, 900, np.uint8))
    assert tiff.unpack_lzw(_lzw(raw)) == raw


def _put(files, folder):
    for r in files.collect():
        (folder / r["name"]).write_bytes(r["content"])


def test_las_is_written_and_read(spark, tmp_path):
    points = [(650000.0 + i / 7, 6860000.0 - i / 3, i / 9, i, i % 200, i * 0.5) for i in range(500)]
    rows = spark.createDataFrame([*points, (None, 1.0, 1.0, 1, 1, 1.0)], "x double, y double, z double, intensity int, classification int, gps_time double").repartition(3)
    _put(las.write_las(rows, 0.001, most=100), tmp_path)
    got = sorted((r["intensity"], r["classification"], r["gps_time"], r["x"], r["y"], r["z"]) for r in las.read_las(spark, str(tmp_path)).collect())
    assert len(list(tmp_path.iterdir())) >= 5 and len(got) == 500
    assert all(g[:3] == (i, i % 200, i * 0.5) and max(abs(a - b) for a, b in zip(g[3:], p[:3], strict=True)) < 6e-4 for i, (g, p) in enumerate(zip(got, points, strict=True)))
    assert las.write_las(rows.where("false")).count() == 0


def test_grids_are_written_and_read(spark, tmp_path):
    nodes = [(r, c, None if (r, c) == (2, 3) else r * 100 + c + 0.25) for r in range(9) for c in range(11) if (r + c) % 5]
    grid = spark.createDataFrame(nodes, "row_ long, col long, z double")
    (tmp_path / "t").mkdir()
    _put(tiff.write_tiff(grid, 1000.0, 2000.0, 10.0, side=4), tmp_path / "t")
    wanted = sorted((1000.0 + 10 * c, 2000.0 - 10 * r, z) for r, c, z in nodes if z is not None)
    assert sorted((r["x"], r["y"], r["value"]) for r in tiff.read_tiff(spark, str(tmp_path / "t")).where("value is not null").collect()) == wanted
    lines = [r["value"] for r in text.asc_lines(grid, 1000.0, 2000.0, 10.0).orderBy("line").collect()]
    (tmp_path / "a.asc").write_text("\n".join(lines) + "\n")
    assert sorted((r["x"], r["y"], r["z"]) for r in text.read_asc(spark, str(tmp_path / "a.asc")).where("z is not null").collect()) == wanted
    assert tiff.write_tiff(grid.where("false"), 0.0, 0.0, 1.0).count() == 0 == text.asc_lines(grid.where("false"), 0.0, 0.0, 1.0).count()
