import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.operators import blur, rasterise


def plain_blur(v: np.ndarray, radius: float) -> np.ndarray:
    """Pixel after pixel, over the whole image."""
    a, v = blur.weight(radius), v.copy()
    for _ in range(2):
        for lines in (list(v), list(v.T)):
            for line in lines:
                there = np.flatnonzero(~np.isnan(line))
                for way in (there, there[::-1]):
                    if len(way):
                        old = line[way[0]]
                        for k in way:
                            if way is there or k != 0:
                                line[k] = old = (1 - a) * line[k] + a * old
    return v


def frame(spark, v: np.ndarray):
    return spark.createDataFrame([(r, c, None if np.isnan(x) else float(x)) for (r, c), x in np.ndenumerate(v)], "row_ long, col long, value double").repartition(3)


@pytest.mark.parametrize("radius,side,holes", [(4.0, 4, False), (1.0, 5, True), (40.0, 7, True), (2.5, 64, False)])
def test_blur(spark, radius, side, holes):
    rng = np.random.default_rng(int(radius))
    v = rng.random((13, 18))
    if holes:
        v[rng.random(v.shape) < 0.3] = np.nan
        v[3] = v[:, 6] = np.nan
        v[4:9, 0:5] = np.nan  # a whole tile
    want = plain_blur(v, radius)
    got = {(r.row_, r.col): r.value for r in blur.blurred(frame(spark, v), radius, side).collect()}
    assert got.keys() == {k for k, x in np.ndenumerate(v) if not np.isnan(x)}
    assert all(abs(got[k] - want[k]) < 1e-12 for k in got)


def test_blur_of_nothing(spark):
    v = np.array([[1.0, 2.0]])
    assert {r.value for r in blur.blurred(frame(spark, v), 0.2).collect()} == {1.0, 2.0}
    assert blur.blurred(frame(spark, v).limit(0), 3.0).count() == 0


@pytest.mark.parametrize("threshold", [0.0, 90.0])
def test_sharpen(spark, threshold):
    rng = np.random.default_rng(8)
    rgb = rng.random((9, 11, 3))
    mean = rgb.mean(axis=2)
    d = (mean - plain_blur(mean, 4.0)) * (2.5 * 0.6**3 * 10)
    low = threshold * (2.5 * 0.6**3 * 10) / 250
    d = np.where(np.abs(d) >= low, d, np.where(np.abs(d) > low / 2, np.sign(d) * (np.abs(d) - low / 2) * 2, 0))
    want = np.clip(rgb + d[:, :, None], 0, 1)
    rows = [(r, c, *map(float, rgb[r, c])) for r in range(9) for c in range(11)]
    image = spark.createDataFrame([*rows, (0, 20, None, 0.5, 0.5)], "row_ long, col long, r double, g double, b double")
    got = blur.sharpened(image, 4.0, 60.0, threshold, 4).collect()
    assert len(got) == 99 and all(np.allclose((x.r, x.g, x.b), want[x.row_, x.col], atol=1e-12) for x in got)


def inside(rings, x, y) -> bool:
    odd = False
    for pts in rings:
        for (ax, ay), (bx, by) in zip(pts, [*pts[1:], pts[0]], strict=True):
            if ay != by and (ay <= y) != (by <= y) and ax + (y - ay) / (by - ay) * (bx - ax) > x:
                odd = not odd
    return odd


def test_rasterise(spark):
    rng = np.random.default_rng(2)
    shapes = {1: [[(1.0, 1.0), (9.0, 1.0), (9.0, 9.0), (1.0, 9.0)], [(3.0, 3.0), (3.0, 6.0), (6.0, 6.0), (6.0, 3.0), (3.0, 3.0)]], 2: [[(0.0, 0.0), (12.0, 6.5), (0.5, 12.0), (4.0, 6.0)]], 3: [[(5.0, 5.0), (6.0, 6.0)]], 4: [[(-50.0, -50.0), (50.0, -50.0), (0.0, 60.0)]]}
    for k in range(5, 12):  # stars that cross themselves
        shapes[k] = [[tuple(map(float, p)) for p in rng.integers(-3, 16, (7, 2)) + rng.choice([0, 0.5], (7, 2))] for _ in range(2)]
    rings = spark.createDataFrame([(k, [{"x": x, "y": y} for x, y in pts]) for k, s in shapes.items() for pts in s], "feature_id long, pts array<struct<x:double,y:double>>")
    got = [tuple(r) for r in rasterise.cells(rings, 0.0, 12.0, 0.5, 25, 25).collect()]
    want = {(k, r, c) for k, s in shapes.items() for r in range(25) for c in range(25) if inside([p for p in s if len(p) > 2], c * 0.5, 12.0 - r * 0.5)}
    assert len(got) == len(set(got)) and set(got) == want and {k for k, *_ in want} == set(shapes) - {3}
    assert rasterise.cells(rings.withColumn("pts", F.lit(None).cast("array<struct<x:double,y:double>>")), 0.0, 12.0, 0.5, 25, 25).count() == 0
