"""Contours, floods and descents against plain ones over the whole grid, with tiles so small that everything crosses borders."""

from collections import defaultdict, deque

import numpy as np
import pytest

from geoloom.operators import relief


def grid_of(spark, z: np.ndarray):
    rows = [(r, c, None if np.isnan(v) else float(v)) for (r, c), v in np.ndenumerate(z)]
    return spark.createDataFrame(rows, "row_ long, col long, z double").repartition(5)


def hills(seed: int, rows: int = 23, cols: int = 17, holes: bool = True) -> np.ndarray:
    rng = np.random.default_rng(seed)
    r, c = np.mgrid[:rows, :cols]
    z = 20 * np.sin(r / 3) * np.cos(c / 4) + rng.integers(-6, 6, (rows, cols))
    if holes:
        z[rng.random(z.shape) < 0.03] = np.nan
    return z


def plain_contours(z: np.ndarray, step: float) -> dict:
    """Every cell alone; segments are then followed point by point. Points are (row, col, goes down)."""
    out = {}
    for k in range(int(np.ceil(np.nanmin(z) / step)), int(np.floor(np.nanmax(z) / step)) + 1):
        level, follows = k * step, {}
        for r in range(z.shape[0] - 1):
            for c in range(z.shape[1] - 1):
                corner = [z[r, c], z[r, c + 1], z[r + 1, c + 1], z[r + 1, c]]
                if np.isnan(corner).any():
                    continue
                name = [(r, c, 0), (r, c + 1, 1), (r + 1, c, 0), (r, c, 1)]
                high = [v >= level for v in corner]
                down = [p for p in range(4) if high[p] and not high[(p + 1) % 4]]
                up = [p for p in range(4) if not high[p] and high[(p + 1) % 4]]
                for p in down:
                    q = up[0] if len(up) == 1 else (p + (1 if sum(corner) / 4 >= level else 3)) % 4
                    follows[name[p]] = name[q]
        into = set(follows.values())
        for a in [*sorted(follows.keys() - into), *sorted(follows)]:
            way = [a]
            while way[-1] in follows:
                way.append(follows.pop(way[-1]))
            if len(way) > 1:
                ring = way[-1] == a

                def at(p, level=level):
                    x = z[p[0], p[1]], z[p[0] + p[2], p[1] + 1 - p[2]]
                    t = (level - x[0]) / (x[1] - x[0])
                    return round(p[1] + (0 if p[2] else t), 9), round(p[0] + (t if p[2] else 0), 9)

                out[level, a] = (ring, [at(p) for p in (way[:-1] if ring else way)])
    return out


@pytest.mark.parametrize("seed,tile", [(1, 4), (2, 7), (3, 64)])
def test_contours(spark, seed, tile):
    z = hills(seed)
    got = defaultdict(list)
    closed = {}
    for x in relief.contours(grid_of(spark, z), 5.0, tile).collect():
        name = x.level, (x.line >> 33, x.line >> 1 & 0xFFFFFFFF, x.line & 1)
        got[name].append((x.seq, (round(x.u, 9), round(x.v, 9))))
        closed[name] = x.closed
    want = plain_contours(z, 5.0)
    assert any(ring for ring, _ in want.values()) and not all(ring for ring, _ in want.values())
    assert got.keys() == want.keys()
    for name, (ring, way) in want.items():
        assert closed[name] == ring and [s for s, _ in sorted(got[name])] == list(range(len(way)))
        assert [p for _, p in sorted(got[name])] == way


def test_contours_of_saddles_flats_and_nothing(spark):
    z = np.array([[9.0, 1, 9], [1, 9, 1], [9, 1, 9]])
    got = defaultdict(set)
    for x in relief.contours(grid_of(spark, z), 4.0, 2).collect():
        got[x.level, x.line].add((x.u, x.v))
    assert sorted(map(len, got.values())) == sorted(len(w) for _, w in plain_contours(z, 4.0).values())
    assert relief.contours(grid_of(spark, np.full((5, 5), 4.0)), 4.0, 2).count() == 0
    assert relief.contours(grid_of(spark, z).limit(0), 4.0, 2).count() == 0


def plain_flood(z, seeds, level):
    seen = {s for s in seeds if 0 <= s[0] < z.shape[0] and 0 <= s[1] < z.shape[1] and z[s] <= level}
    todo = deque(seen)
    while todo:
        r, c = todo.popleft()
        for n in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
            if 0 <= n[0] < z.shape[0] and 0 <= n[1] < z.shape[1] and n not in seen and z[n] <= level:
                seen.add(n)
                todo.append(n)
    return {(r, c, round(level - z[r, c], 9)) for r, c in seen}


@pytest.mark.parametrize("level,tile", [(-12.0, 4), (0.0, 5), (3.0, 3), (40.0, 6)])
def test_flood(spark, level, tile):
    z = hills(4)
    seeds = [(0, 0), (9, 13), (22, 16), (17, 3), (99, 1)]
    frame = spark.createDataFrame(seeds, "row_ long, col long")
    got = [(x.row_, x.col, round(x.depth, 9)) for x in relief.flood(grid_of(spark, z), frame, level, tile).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_flood(z, seeds, level)


def test_flood_of_a_spiral(spark):
    z = np.full((15, 15), 9.0)
    r = c = 0
    turn, left = 0, {(r, c)}
    for length in (14, 14, 14, 12, 12, 10, 10, 8, 8, 6, 6, 4, 4, 2):
        dr, dc = ((0, 1), (1, 0), (0, -1), (-1, 0))[turn % 4]
        for _ in range(length):
            r, c = r + dr, c + dc
            left.add((r, c))
        turn += 1
    for x in left:
        z[x] = 1.0
    seeds = [(0, 0)]
    got = {(x.row_, x.col, x.depth) for x in relief.flood(grid_of(spark, z), spark.createDataFrame(seeds, "row_ long, col long"), 2.0, 3).collect()}
    assert got == plain_flood(z, seeds, 2.0) and len(got) == len(left)


def plain_way(z, r, c):
    way = [(r, c)]
    while True:
        best, to = 0.0, None
        for dr, dc in relief.AROUND:
            n = r + dr, c + dc
            if 0 <= n[0] < z.shape[0] and 0 <= n[1] < z.shape[1] and not np.isnan(z[n]):
                slope = (z[r, c] - z[n]) / np.hypot(dr, dc)
                if slope > best:
                    best, to = slope, n
        if to is None:
            return way
        r, c = to
        way.append(to)


@pytest.mark.parametrize("seed,tile", [(5, 4), (6, 3), (7, 64)])
def test_descents_and_thalwegs(spark, seed, tile):
    z = hills(seed)
    z[3:6, 3:7] = 4.0  # flat
    if seed == 6:
        z = np.add.outer(np.arange(23.0), np.arange(17.0))  # all ways cross the whole grid
    nodes = grid_of(spark, z)
    want = {(r, c): plain_way(z, r, c) for (r, c), v in np.ndenumerate(z) if not np.isnan(v)}
    got = {(x.row_, x.col): (x.pit_row, x.pit_col, x.steps) for x in relief.descents(nodes, tile).collect()}
    assert got == {k: (*w[-1], len(w) - 1) for k, w in want.items()}
    starts = [(22, 16), (0, 0), (11, 8), (4, 4), (50, 50)]
    ways = defaultdict(list)
    for x in relief.thalwegs(nodes, spark.createDataFrame(starts, "row_ long, col long"), tile).collect():
        ways[x.start_row, x.start_col].append((x.seq, (x.row_, x.col)))
    assert {k: [p for _, p in sorted(v)] for k, v in ways.items()} == {k: want[k] for k in starts if k in want}
    assert all([s for s, _ in sorted(v)] == list(range(len(v))) for v in ways.values())
