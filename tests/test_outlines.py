import re

import numpy as np
import pytest

from pyspark.sql import functions as F

from geoloom.operators import lines, order, outlines


def lines_of(spark, shapes):
    return spark.createDataFrame([(k, [{"x": float(x), "y": float(y)} for x, y in pts]) for k, pts in shapes.items()], "id long, pts array<struct<x:double,y:double>>")


def distance(p, a, b):
    d = b - a
    t = np.clip((p - a) @ d / (d @ d), 0, 1) if d @ d else 0.0
    return float(np.hypot(*(p - a - t * d)))


def test_generalised_within_the_tolerance(spark):
    rng = np.random.default_rng(3)
    shapes = {k: np.cumsum(rng.normal(size=(int(rng.integers(1, 200)), 2)), axis=0) for k in range(30)} | {90: np.array([[0, 0], [5, 5], [0, 0.0]]), 91: np.zeros((4, 2)), 92: np.zeros((0, 2))}
    for tolerance in (0.0, 1.5):
        got = {}
        for r in outlines.generalised(lines_of(spark, shapes), tolerance).collect():
            got.setdefault(r.id, []).append((r.at, r.x, r.y))
        assert got.keys() == {k for k, p in shapes.items() if len(p)}
        for k, rows in got.items():
            at, pts = [a for a, *_ in sorted(rows)], shapes[k]
            assert at[0] == 0 and at[-1] == len(pts) - 1 and all((x, y) == tuple(pts[a]) for a, x, y in rows)
            for a, b in zip(at, at[1:], strict=False):
                assert all(distance(p, pts[a], pts[b]) <= tolerance + 1e-9 for p in pts[a + 1 : b])
            if tolerance and len(pts) > 100:
                assert len(at) < len(pts) / 2
    assert sorted(r.at for r in outlines.generalised(lines_of(spark, {1: shapes[90]}), 1.0).collect()) == [0, 1, 2]


def meets(a, b, c, d):
    turn = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    over = all(min(a[k], b[k]) <= max(c[k], d[k]) and min(c[k], d[k]) <= max(a[k], b[k]) for k in (0, 1))
    return over and turn(a, b, c) * turn(a, b, d) <= 0 and turn(c, d, a) * turn(c, d, b) <= 0


@pytest.mark.parametrize("size", [None, 0.7, 3.0, 1000.0])
def test_crossings_by_all_pairs(spark, size):
    rng = np.random.default_rng(6)
    shapes = {k: rng.integers(-8, 8, (int(rng.integers(1, 9)), 2)).astype(float) for k in range(25)}
    shapes |= {50: np.array([[0, 0], [4, 0], [4, 4], [0, 4], [0, 0.0]]), 51: np.array([[0, 0], [5, 0], [5, 5], [2, 0], [9, 0.0]]), 52: np.array([[-20, -20], [20, 20], [20, -20], [-20, 20.0]])}
    seg = {k: list(zip(p, p[1:], strict=False)) for k, p in shapes.items()}
    want = set()
    for k, s in seg.items():
        closed = len(s) and tuple(shapes[k][0]) == tuple(shapes[k][-1])
        want |= {(k, i, j) for j in range(len(s)) for i in range(j - 1) if not (closed and i == 0 and j == len(s) - 1) and meets(*s[i], *s[j])}
    frame = lines_of(spark, shapes)
    got = [(r.id, r.i, r.j) for r in outlines.crossings(frame, True, size).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
    two = {(k, i, m, j) for k, s in seg.items() for m, t in seg.items() if k < m for i in range(len(s)) for j in range(len(t)) if meets(*s[i], *t[j])}
    got = [tuple(r) for r in outlines.crossings(frame, False, size).collect()]
    assert len(got) == len(set(got)) and set(got) == two
    assert outlines.crossings(frame.limit(0)).count() == 0


def test_label_points(spark):
    shapes = {1: np.array([[0, 0], [4, 0], [4, 2], [0, 2.0]]), 2: np.array([[0, 0], [1, 0], [1, 3], [9, 3], [9, 0], [14, 0], [14, 4], [0, 4.0]]), 3: np.array([[0, 1], [5, 1.0]]), 4: np.array([[7, 7.0]])}
    got = {r.id: (r.x, r.y) for r in outlines.label_points(lines_of(spark, shapes)).collect()}
    assert got == {1: (2, 1), 2: (11.5, 2), 3: (2.5, 1), 4: (7, 7)}


def test_fly_path(spark):
    pts = {1: [(0, 0, 5), (3000, 0, 25), (3000, 0.2, None)], 2: [(7, 7, 7)], 3: [(0, 0, 30), (10.4, 0, 40)]}
    frame = spark.createDataFrame([(k, [{"x": float(x), "y": float(y), "z": None if z is None else float(z)} for x, y, z in v]) for k, v in pts.items()], "id long, pts array<struct<x:double,y:double,z:double>>")
    got = {}
    for r in lines.fly_path(frame, 10.0, 50.0).collect():
        got.setdefault(r.id, []).append((r.seg, r.k, r.x, r.y, r.z))
    one = sorted(got[1])
    assert [(s, k) for s, k, *_ in one] == [(0, k) for k in range(0, 3000, 3)] + [(1, 0)]  # 3000.2 m in 1,200 parts, rounded
    assert one[0][2:] == (0, 0, 30) and one[500][2:] == (1500, 0, 27.5) and one[-1][2:] == (3000, 0, 25)
    assert [(s, k, round(x, 9), y, z) for s, k, x, y, z in sorted(got[3])] == [(0, k, round(1.04 * k, 9), 0, 30 + k) for k in range(10)] and got.keys() == {1, 3}


def test_natural_order(spark):
    texts = ["a10", "a9", "A 1", "a010", "b", "", None, "a1b20", "a1b3", "a" + "9" * 30, "a1" + "0" * 30, "a0", "a00", "é2", "10", "9x"]
    frame = spark.createDataFrame(list(enumerate(texts)), "k long, t string").repartition(5)

    def chunks(t):
        t = t or ""
        return "".join("0" + str(len(n)).rjust(8, "0") + n if (n := m.lstrip("0") or "0") and m[0].isdigit() else m for m in re.findall(r"\d+|\D+", t.lower())), t

    want = sorted(range(len(texts)), key=lambda k: (*chunks(texts[k]), k))
    assert [r.k for r in sorted(order.natural_order(frame, "t", "k").collect(), key=lambda r: r.pos)] == want
    down = order.natural_order(frame, "t", "k", True)
    assert [r.k for r in sorted(down.collect(), key=lambda r: r.pos)] == want[::-1] and down.columns == ["k", "t", "pos"]
    assert want.index(1) < want.index(0) and want.index(9) < want.index(10) and order.natural_order(frame.limit(0), "t", "k").count() == 0


def test_places_in_groups(spark):
    rows = [(k % 3 if k % 7 else None, (k * 37) % 101) for k in range(101)]
    got = order.numbered_in(spark.createDataFrame(rows, "g long, v long").repartition(6).where("g is not null"), "g", [F.col("v").desc()]).collect()
    for g in range(3):
        mine = sorted((r.pos, r.v) for r in got if r.g == g)
        assert [v for _, v in mine] == sorted((v for x, v in rows if x == g), reverse=True) and [p for p, _ in mine] == list(range(1, len(mine) + 1))


def test_lines_of_a_batch_are_simplified_as_each_alone():
    rng = np.random.default_rng(6)
    sizes = [1, 2, 3, 4, 7, 60, 1, 5, 300, 2]
    x, y = rng.integers(0, 30, sum(sizes)).astype(float), rng.integers(0, 30, sum(sizes)).astype(float)
    ends = np.cumsum(sizes)
    keep = outlines.marked(x, y, ends - sizes, ends, 6.0)

    def plain(lo, hi):
        if hi - lo < 2:
            return set()
        a, b = np.array([x[lo], y[lo]]), np.array([x[hi] - x[lo], y[hi] - y[lo]])
        far = []
        for k in range(lo + 1, hi):
            p, square = np.array([x[k], y[k]]) - a, b @ b
            t = min(1, max(0, p @ b / square)) if square else 0
            far.append(((p - t * b) ** 2).sum())
        k = lo + 1 + int(np.argmax(far))
        return {k} | plain(lo, k) | plain(k, hi) if max(far) > 36 else set()

    want = set().union(*({e - n, e - 1} | plain(e - n, e - 1) for e, n in zip(ends, sizes, strict=True)))
    assert set(np.flatnonzero(keep)) == want and 20 < len(want) < sum(sizes)
