import numpy as np
import pytest

from geoloom.functions.geometry import Frame
from geoloom.sources import cog, tiff


@pytest.fixture(scope="module")
def stored(tmp_path_factory):
    rng = np.random.default_rng(4)
    v = rng.random((37, 50)).astype("f4").astype(float)
    v[5:9, 3:20] = np.nan
    folder = tmp_path_factory.mktemp("cog")
    (folder / "a.tif").write_bytes(cog.file_of(v, 1000.0, 2000.0, 2.0, -9999.0, 8, 2))
    return str(folder), v


def test_levels_and_values(spark, stored):
    folder, v = stored
    images = [v, cog.halved(v), cog.halved(cog.halved(v))]
    for wanted, k in ((1, 0), (1.9, 0), (2, 1), (3.5, 1), (4, 2), (99, 2), (0.1, 0)):
        rows = cog.read_cog(spark, folder, wanted).collect()
        want = images[k].astype("f4")
        assert len(rows) == want.size and {r.factor for r in rows} == {2**k}
        step = 2.0 * 2**k
        for r in rows:
            assert (r.value is None and np.isnan(want[r.row_, r.col])) or r.value == want[r.row_, r.col]
            assert abs(r.x - (1000 + (r.col + 0.5) * step)) < 1e-9 and abs(r.y - (2000 - (r.row_ + 0.5) * step)) < 1e-9


def test_frame_reads_its_tiles_alone(spark, stored, monkeypatch):
    folder, v = stored
    frame = Frame(1030.0, 1950.0, 1055.0, 1968.0)
    got = {(r.row_, r.col) for r in cog.read_cog(spark, folder, 1, frame).collect()}
    assert got == {(r, c) for r in range(37) for c in range(50) if 1030 <= 1001 + 2 * c <= 1055 and 1950 <= 1999 - 2 * r <= 1968}
    reader = cog.Reader({"path": folder, "frame": "[1030.0, 1950.0, 1055.0, 1968.0]"})
    numbers = [k for p in reader.partitions() for k in p.numbers]
    assert 0 < len(numbers) <= 9 < 35
    assert len(cog.Reader({"path": folder}).partitions()) == 1  # 35 tiles
    monkeypatch.setattr(cog, "A_PART", 10)
    assert [len(p.numbers) for p in cog.Reader({"path": folder}).partitions()] == [10, 10, 10, 5]


def test_first_image_as_a_plain_tiff(spark, stored):
    folder, v = stored
    got = {(r.row_, r.col): r.value for r in tiff.read_tiff(spark, folder).collect()}
    assert len(got) == v.size and all((x is None) == bool(np.isnan(v[k])) and (x is None or x == v[k]) for k, x in got.items())


def test_strips_have_one_level(spark, tmp_path):
    (tmp_path / "s.tif").write_bytes(tiff.file_of(np.arange(12.0).reshape(3, 4), 0.0, 9.0, 1.0, -1.0))
    rows = cog.read_cog(spark, str(tmp_path), 8).collect()
    assert sorted((r.row_, r.col, r.value, r.factor) for r in rows) == [(i, j, 4.0 * i + j, 1) for i in range(3) for j in range(4)]
