"""Nearest points by cells that grow: held against plain loops, ties and dense places included."""

import random

from geoloom.operators import nearest

SCHEMA = "l_orderkey long, l_linenumber int, x double, y double, z double"


def _features(spark, rng, n):
    rows = [(i, "a" if i % 3 else None, rng.randrange(3000) / 100, rng.randrange(3000) / 100, rng.randrange(-900, 2000) / 100) for i in range(n)]
    return rows, spark.createDataFrame(rows, "feature_id long, class string, x double, y double, z double")


def _points(spark, rng, n):
    rows = [(i // 4, i % 4, rng.randrange(0, 3000, 10) / 100, rng.randrange(0, 2000, 10) / 100, rng.randrange(0, 1000, 50) / 100) for i in range(n)]
    return rows, spark.createDataFrame(rows, SCHEMA)


def test_nearest_as_by_plain_loops(spark):
    rng = random.Random(3)
    (features, f), (points, p) = _features(spark, rng, 150), _points(spark, rng, 4000)
    space, plane = {}, {}
    for i, _, x, y, z in features:
        near = [((x - px) * (x - px) + (y - py) * (y - py) + (z - pz) * (z - pz), -a, -b, pz) for a, b, px, py, pz in points]
        near = [m for m in near if m[0] <= 25.0]
        flat = [((x - px) * (x - px) + (y - py) * (y - py), a, b, pz) for a, b, px, py, pz in points if abs(x - px) <= 2 and abs(y - py) <= 2]
        space |= {i: z - min(near)[3]} if near else {}
        plane |= {i: min(flat)[3]} if flat else {}
    assert {r["feature_id"]: r["delta"] for r in nearest.delta_to_points(f, p, 5.0).collect()} == space
    assert {r["feature_id"]: r["z"] for r in nearest.nearest_height(f, p, 2.0).collect()} == plane
    assert 0 < len(space) < 150 and 0 < len(plane) < 150


def test_pairs_do_not_grow_with_density(spark, monkeypatch):
    rng, pairs, plain = random.Random(4), [], nearest.neighbours
    monkeypatch.setattr(nearest, "neighbours", lambda *a: pairs.append(plain(*a).count()) or plain(*a))
    (_, f), (_, p) = _features(spark, rng, 100), _points(spark, rng, 20_000)
    nearest.nearest_height(f.where("y < 20"), p, 20.0).collect()
    assert sum(pairs) < 100 * 9 * 3 * nearest.DENSE


def test_nothing_to_find(spark):
    (_, f), (_, p) = _features(spark, random.Random(5), 5), _points(spark, random.Random(5), 5)
    assert nearest.nearest_height(f, p.where("false"), 2.0).count() == nearest.delta_to_points(f.where("false"), p, 2.0).count() == 0
