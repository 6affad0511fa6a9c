"""Contour lines, floods and descents of elevation grids, by tiles.

Nodes (row_, col, z) go to square tiles of TILE nodes a side, those at a border to the neighbours that need them too. A task
solves a tile in numpy; what crosses borders is joined by ``chains`` over border points alone, so no task holds a grid, a row
of it or a line, and the number of rounds is logarithmic. A node without height is left out like one that is not there.
Nodes are told apart by row and column, which must not be negative nor reach 2 ** 30; of rows for one node the lowest counts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.operators import chains
from geoloom.operators.shared import Written

TILE = 512


def _tiles(nodes: DataFrame, tile: int, before: int, after: int, *more: str) -> DataFrame:
    """nodes with their tiles (tr, tc): a node also goes to tiles of which it is up to ``before`` nodes ahead or ``after`` nodes behind the borders."""
    side = lambda c: F.array_distinct(F.array(*(F.floor((F.col(c) + d) / tile) for d in sorted({before, 0, -after})))).cast("array<long>")
    whole = nodes.where("z is not null").groupBy("row_", "col").agg(F.min("z").alias("z"), *(F.max(c).alias(c) for c in more))
    return whole.withColumn("tr", F.explode(side("row_"))).withColumn("tc", F.explode(side("col"))).where("tr >= 0 and tc >= 0")


def _square(group: pd.DataFrame, r0: int, c0: int, side: int, column: str = "z", none: float = np.nan) -> np.ndarray:
    out = np.full((side, side), none)
    out[group["row_"].to_numpy() - r0, group["col"].to_numpy() - c0] = group[column].to_numpy()
    return out


# --- contours

PIECE = "k long, edge long, then long, n long, closed boolean, low long, low_at long, us array<double>, vs array<double>, u1 double, v1 double"


def _segments(z: np.ndarray, level: float, r0: int, c0: int) -> dict[int, int]:
    """Directed segments of a tile, from edge to edge; higher ground lies on one side of all of them.

    Around a cell, clockwise from its first corner, a segment runs from an edge that goes down to one that goes up; where there are two
    of each, the mean of the corners tells which of them belong together. An edge is its first node, and whether it goes down the rows.
    """
    corner = np.stack([z[:-1, :-1], z[:-1, 1:], z[1:, 1:], z[1:, :-1]])
    full = ~np.isnan(corner).any(axis=0)
    high = corner >= level
    turn = np.roll(high, -1, axis=0)
    down, up = high & ~turn & full, ~high & turn & full
    middle, two = corner.mean(axis=0) >= level, down.sum(axis=0) == 2
    rows, cols = np.mgrid[r0 : r0 + z.shape[0] - 1, c0 : c0 + z.shape[1] - 1]
    edge = [(rows + (p == 2)) << 33 | (cols + (p == 1)) << 1 | p % 2 for p in range(4)]
    out: dict[int, int] = {}
    for p in range(4):
        for q in range(4):
            fits = down[p] & up[q] & (~two | (q == np.where(middle, (p + 1) % 4, (p + 3) % 4)))
            out.update(zip(edge[p][fits].tolist(), edge[q][fits].tolist(), strict=True))
    return out


def _places(ids: list[int], z: np.ndarray, level: float, r0: int, c0: int) -> tuple[list[float], list[float]]:
    """Columns and rows of points on edges."""
    edge = np.array(ids)
    below, row, col = edge & 1, edge >> 33, edge >> 1 & 0xFFFFFFFF
    a, b = z[row - r0, col - c0], z[row - r0 + below, col - c0 + 1 - below]
    at = (level - a) / (b - a)
    return (col + np.where(below, 0, at)).tolist(), (row + np.where(below, at, 0)).tolist()


def _pieces(tile: int, step: float):
    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = int(key[0]) * tile, int(key[1]) * tile
        z, out = _square(group, r0, c0, tile + 1), []
        for k in range(int(np.ceil(np.nanmin(z) / step)), int(np.floor(np.nanmax(z) / step)) + 1):
            follows = _segments(z, k * step, r0, c0)
            into = set(follows.values())
            for a in [*sorted(follows.keys() - into), *sorted(follows)]:  # pieces that come from outside first, then rings
                way = [a]
                while way[-1] in follows:
                    way.append(follows.pop(way[-1]))
                if len(way) > 1:
                    ring = way[-1] == a
                    us, vs = _places(way, z, k * step, r0, c0)
                    low = min(way[:-1])
                    out.append((k, a, None if ring else way[-1], len(way) - 1, ring, low, way.index(low), us[:-1], vs[:-1], us[-1], vs[-1]))
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in PIECE.split(", ")])
        frame["then"] = frame["then"].astype("Int64")
        return frame.astype({"us": object, "vs": object})

    return run


def contours(nodes: DataFrame, step: float, tile: int = TILE) -> DataFrame:
    """Contour lines of all multiples of ``step``: a row per vertex: level, line, closed, seq (from 0), u (column), v (row).

    A line is named by the edge of its first vertex; a closed line begins at its smallest edge and does not repeat its first vertex. Cells
    without all four nodes have no lines; a node at a level counts as above it.
    """
    made = Written(nodes.sparkSession)
    pieces = made(_tiles(nodes, tile, 0, 1).groupBy("tr", "tc").applyInPandas(_pieces(tile, step), PIECE), "contour-pieces")
    pieces = pieces.withColumn("id", F.struct("k", "edge"))
    parts = pieces.where("not closed")
    before = parts.select(F.struct("k", F.col("then").alias("edge")).alias("id"), F.col("id").alias("nxt"))
    links = parts.select("id", F.col("n").alias("size")).join(before, "id", "left")  # towards the line's beginning
    found = chains.ends(links, made)
    rings = links.join(found.where("last is null").select("id", "low"), "id").withColumn("nxt", F.when(F.col("id") != F.col("low"), F.col("nxt")))
    cut = chains.ends(rings.select("id", "nxt", "size"), made)
    placed = found.where("last is not null").select("id", "last", "total", F.lit(False).alias("ring")).unionByName(cut.select("id", "last", "total", F.lit(True).alias("ring")))
    lines = parts.join(placed, "id")
    final = lines.where("not ring").join(parts.select(F.col("k"), F.col("edge").alias("then")), ["k", "then"], "left_anti")  # where a line leaves the grid
    none, vertices = F.lit(0).cast("long"), F.arrays_zip("us", "vs").alias("p")
    whole = pieces.where("closed").select("k", F.col("edge").alias("line"), F.lit(True).alias("closed"), none.alias("first"), none.alias("turn"), F.lit(1 << 62).alias("size"), vertices)
    first = F.col("total") - F.col("n")
    rings = lines.where("ring").groupBy("k", "last").agg(F.min(F.struct("low", (first + F.col("low_at")).alias("at"))).alias("m"), F.max("total").alias("size"))
    turned = lines.where("ring").join(rings, ["k", "last"]).select("k", F.col("m.low").alias("line"), F.lit(True).alias("closed"), first.alias("first"), F.col("m.at").alias("turn"), "size", vertices)
    some = lines.where("not ring").select("k", F.col("last.edge").alias("line"), F.lit(False).alias("closed"), first.alias("first"), none.alias("turn"), F.lit(1 << 62).alias("size"), vertices)
    last = final.select("k", F.col("last.edge").alias("line"), F.lit(False).alias("closed"), F.col("total").alias("first"), none.alias("turn"), F.lit(1 << 62).alias("size"), F.array(F.struct(F.col("u1").alias("us"), F.col("v1").alias("vs"))).alias("p"))
    every = whole.unionByName(some).unionByName(turned).unionByName(last).select("*", F.posexplode("p").alias("at", "q"))
    seq = F.pmod(F.col("first") + F.col("at") - F.col("turn"), F.col("size"))
    return every.select((F.col("k") * F.lit(float(step))).alias("level"), "line", "closed", seq.alias("seq"), F.col("q.us").alias("u"), F.col("q.vs").alias("v"))


# --- floods

LABELLED = "row_ long, col long, z double, label long, own boolean"
NODE = 1 << 32


def _labels(low: np.ndarray) -> np.ndarray:
    """Numbers of the connected parts of a mask (sides only), -1 elsewhere: runs of a row are joined with those above that they touch."""
    out, parent = np.full(low.shape, -1), []

    def find(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for r, line in enumerate(low):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], line.view(np.int8), [0]])))
        for a, b in zip(edges[::2], edges[1::2], strict=True):
            mine = len(parent)
            parent.append(mine)
            out[r, a:b] = mine
            for other in np.unique(out[r - 1, a:b]) if r else ():
                if other >= 0:
                    x, y = find(int(other)), find(mine)
                    parent[max(x, y)] = min(x, y)
    roots = np.array([find(k) for k in range(len(parent))] + [-1])
    return roots[out]


def _lakes(tile: int, level: float):
    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = int(key[0]) * tile, int(key[1]) * tile
        z = _square(group, r0, c0, tile + 1)
        part = _labels(z <= level)
        r, c = np.nonzero(part >= 0)
        node = (r + r0) * NODE + c + c0
        first = np.full(part.max() + 1 if len(r) else 0, np.iinfo(np.int64).max)
        np.minimum.at(first, part[r, c], node)
        return pd.DataFrame({"row_": r + r0, "col": c + c0, "z": z[r, c], "label": first[part[r, c]], "own": (r < tile) & (c < tile)})

    return run


def flood(nodes: DataFrame, seeds: DataFrame, level: float, tile: int = TILE) -> DataFrame:
    """Nodes that water at ``level`` reaches from ``seeds`` (row_, col) over sides of nodes that are not above it: row_, col, depth.

    Tiles are labelled alone, with the first row and column of the next ones; nodes with two labels pair these, and pairs become groups.
    A seed that is above the level, or no node, floods nothing.
    """
    made = Written(nodes.sparkSession)
    wet = made(_tiles(nodes, tile, 0, 1).groupBy("tr", "tc").applyInPandas(_lakes(tile, level), LABELLED), "lakes")
    own, ahead = wet.where("own"), wet.where("not own")
    border = own.where((F.col("row_") % tile == 0) | (F.col("col") % tile == 0)).select("row_", "col", F.col("label").alias("a"))
    roots = chains.groups(ahead.select("row_", "col", F.col("label").alias("b")).join(border, ["row_", "col"]).select("a", "b"), made)
    at = [F.floor(F.col(c) / tile).alias(t) for c, t in (("row_", "tr"), ("col", "tc"))]
    labels = own.select("label", *at).distinct().join(roots.select(F.col("id").alias("label"), "root"), "label", "left").select("tr", "tc", "label", F.coalesce("root", "label").alias("root"))
    labels = made(labels, "labels")
    hit = own.join(seeds.select("row_", "col").distinct(), ["row_", "col"]).select("label", *at).distinct().join(labels, ["tr", "tc", "label"]).select("root").distinct()
    reached = labels.join(hit, "root", "left_semi").select("tr", "tc", "label")
    return own.withColumns({"tr": at[0], "tc": at[1]}).join(reached, ["tr", "tc", "label"], "left_semi").select("row_", "col", (F.lit(float(level)) - F.col("z")).alias("depth"))


# --- descents

DOWN = "row_ long, col long, id long, exit long, steps long, inside boolean"
AROUND = [(dr, dc) for dr in (-1, 0, 1) for dc in (-1, 0, 1) if dr or dc]


def _falls(z: np.ndarray) -> np.ndarray:
    """Of each inner cell of a square, the place in it of the neighbour with the steepest way down (the first in reading order of several), or its own."""
    n = z.shape[0]
    inner = z[1:-1, 1:-1]
    best, to = np.zeros(inner.shape), np.arange(n * n).reshape(n, n)[1:-1, 1:-1].copy()
    for dr, dc in AROUND:
        slope = (inner - z[1 + dr : n - 1 + dr, 1 + dc : n - 1 + dc]) / np.hypot(dr, dc)
        more = slope > best
        best[more] = slope[more]
        to[more] += (dr * n + dc) - (to[more] - np.arange(n * n).reshape(n, n)[1:-1, 1:-1][more])
    return to


def _ways(tile: int):
    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = int(key[0]) * tile - 1, int(key[1]) * tile - 1
        z = _square(group, r0, c0, tile + 2)
        to = np.arange(z.size)
        inner = to.reshape(z.shape)[1:-1, 1:-1].ravel()
        to[inner] = _falls(z).ravel()  # cells of the frame point to themselves: the way leaves the tile there
        steps = (to != np.arange(z.size)).astype(np.int64)
        while (to[to] != to).any():
            steps, to = steps + steps[to], to[to]
        mine = inner[~np.isnan(z.ravel()[inner])]
        node = lambda k: (k // z.shape[1] + r0) * NODE + k % z.shape[1] + c0
        ends = to[mine]
        inside = (ends // z.shape[1] % (tile + 1) > 0) & (ends % z.shape[1] % (tile + 1) > 0)
        return pd.DataFrame({"row_": mine // z.shape[1] + r0, "col": mine % z.shape[1] + c0, "id": node(mine), "exit": node(ends), "steps": steps[mine], "inside": inside})

    return run


def _entries(ways: DataFrame) -> DataFrame:
    """Ways of the nodes at which others enter their tile."""
    targets = ways.where("not inside").select(F.col("exit").alias("id")).distinct()
    return ways.join(targets, "id", "left_semi")


def descents(nodes: DataFrame, tile: int = TILE) -> DataFrame:
    """Where water from each node ends: row_, col, pit_row, pit_col, steps.

    A node falls to the neighbour of eight with the steepest way down, the first in reading order of equals; one without lower neighbour is a
    pit and ends there, on flat ground too. Tiles are followed alone; ways that leave one are joined at the nodes where they enter the next.
    """
    made = Written(nodes.sparkSession)
    ways = made(_tiles(nodes, tile, 1, 1).groupBy("tr", "tc").applyInPandas(_ways(tile), DOWN), "ways")
    entries = made(_entries(ways), "entries")
    found = chains.ends(entries.select("id", F.when(~F.col("inside"), F.col("exit")).alias("nxt"), F.col("steps").alias("size")), made)
    pits = found.join(entries.select(F.col("id").alias("last"), F.col("exit").alias("pit")), "last").select(F.col("id").alias("exit"), "pit", F.col("total").alias("more"))
    out = ways.where("not inside").join(pits, "exit").select("row_", "col", "pit", (F.col("steps") + F.col("more")).alias("steps")).unionByName(ways.where("inside").select("row_", "col", F.col("exit").alias("pit"), "steps"))
    return out.select("row_", "col", F.expr(f"pit div {NODE}").alias("pit_row"), (F.col("pit") % NODE).alias("pit_col"), "steps")


def thalwegs(nodes: DataFrame, starts: DataFrame, tile: int = TILE) -> DataFrame:
    """Ways down from ``starts`` (row_, col) to their pits: start_row, start_col, seq (from 0), row_, col. A start that is no node has no way."""
    made = Written(nodes.sparkSession)
    tiles = _tiles(nodes, tile, 1, 1)
    ways = made(tiles.groupBy("tr", "tc").applyInPandas(_ways(tile), DOWN), "ways")
    begun = ways.join(starts.select("row_", "col").distinct(), ["row_", "col"])
    links = _entries(ways).unionByName(begun).dropDuplicates(["id"]).select("id", F.when(~F.col("inside"), F.col("exit")).alias("nxt"), F.col("steps").alias("size"))
    seen = chains.visits(links, begun.select(F.col("id").alias("start"), "id"), made)
    side = lambda e: F.floor(e / tile)
    seen = seen.withColumn("tr", side(F.expr(f"id div {NODE}"))).withColumn("tc", side(F.col("id") % NODE))

    def walk(key: tuple, group: pd.DataFrame, entered: pd.DataFrame) -> pd.DataFrame:
        if not len(group) or not len(entered):
            return pd.DataFrame({c: pd.Series([], dtype="int64") for c in ("start", "seq", "id")})
        r0, c0 = int(key[0]) * tile - 1, int(key[1]) * tile - 1
        z = _square(group, r0, c0, tile + 2)
        wide, falls = z.shape[1], _falls(z)
        start, seq, place = [], [], []
        for s, node, before in entered[["start", "id", "before"]].itertuples(index=False):
            k = (node // NODE - r0) * wide + node % NODE - c0
            while True:
                start.append(s)
                seq.append(before)
                place.append((k // wide + r0) * NODE + k % wide + c0)
                then = falls[k // wide - 1, k % wide - 1]
                if then == k or not (0 < then // wide <= tile and 0 < then % wide <= tile):
                    break
                k, before = then, before + 1
        return pd.DataFrame({"start": start, "seq": seq, "id": place})

    rows = tiles.groupBy("tr", "tc").cogroup(seen.groupBy("tr", "tc")).applyInPandas(walk, "start long, seq long, id long")
    part = lambda c: (F.expr(f"{c} div {NODE}"), F.col(c) % NODE)
    return rows.select(part("start")[0].alias("start_row"), part("start")[1].alias("start_col"), "seq", part("id")[0].alias("row_"), part("id")[1].alias("col"))
