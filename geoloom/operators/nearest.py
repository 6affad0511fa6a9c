"""Radius and nearest joins by grid buckets: the probing side goes to its 9 cells, so the join is an equi-join on the cell."""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.functions.grids import crossings
from geoloom.operators.shared import Written

ZONE_CELL = 100.0


def _cell(size: float) -> tuple:
    return F.floor(F.col("x") / size), F.floor(F.col("y") / size)


def neighbours(probe: DataFrame, points: DataFrame, size: float, solid: bool = False) -> DataFrame:
    """Pairs whose cells of ``size`` touch, in space if ``solid``; ``points`` has its columns renamed to px, py, pz and its keys as they are."""
    axes = "xyz" if solid else "xy"
    cell, near = {f"_c{c}": F.floor(F.col(c) / size) for c in axes}, probe
    for name, at in cell.items():
        near = near.withColumn(name, F.explode(F.array(*(at + k for k in (-1, 0, 1)))))
    held = points.withColumns(cell).withColumnsRenamed({"x": "px", "y": "py", "z": "pz"})
    return near.join(held, list(cell)).drop(*cell)


DENSE = 2.0  # points of a cell, on average, where a search begins
WIDER = 1 + 1e-6  # cells are so much wider than what is looked for, so that no point is lost to rounding


def nearest_within(probe: DataFrame, points: DataFrame, radius: float, keys: list[str], order: list, solid: bool = False, square: bool = False) -> DataFrame:
    """(keys, pz): the height of the point nearest to each probe within the radius, in space if ``solid``; of equals the first in ``order`` (columns of points).

    With ``square`` it is the nearest one in a square of the radius to each side. Cells begin so small that they hold DENSE points or so: what a
    probe's own and touching cells hold within a cell's size is its answer, and only probes without one go on, to cells twice as large. So pairs
    grow with the probes, not with probes times density. In later rounds points come from the box around the probes that are left.
    """
    axes = "xyz" if solid else "xy"
    points = points.select("x", "y", "z", "l_orderkey", "l_linenumber")
    ends = [f(c).alias(f"{c}{k}") for c in axes for k, f in enumerate((F.min, F.max))]
    box = points.agg(F.count("*").alias("n"), *ends).first()
    sides = [max(box[f"{c}1"] - box[f"{c}0"], radius * 1e-3) if box[f"{c}0"] is not None else radius for c in axes]
    size = min(radius, (DENSE * math.prod(sides) / max(box["n"], 1)) ** (1 / len(axes)))
    d = {c: F.col(c) - F.col(f"p{c}") for c in axes}
    d2 = sum((d[c] * d[c] for c in axes[1:]), d["x"] * d["x"])
    made, done, left = Written(probe.sparkSession), None, probe.select(*dict.fromkeys((*keys, "x", "y", "z")))
    while True:
        near = (F.abs(d["x"]) <= radius) & (F.abs(d["y"]) <= radius) if size == radius and square else F.col("d2") <= size * size
        best = neighbours(left, points, size * WIDER, solid).withColumn("d2", d2).where(near).groupBy(*keys).agg(F.min_by("pz", F.struct("d2", *order)).alias("pz"))
        if size == radius:
            return best if done is None else done.union(best)
        found = made(best, "nearest")
        done = found if done is None else done.union(found)
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        left = made(left.join(found.select(*(F.col(k).alias(f"_{k}") for k in keys)), reduce(and_, same), "left_anti"), "left")
        box = left.agg(F.count("*").alias("n"), *ends).first()
        if not box["n"]:
            return done
        size = min(radius, 2 * size)
        for c in axes:
            if box[f"{c}0"] is not None:
                points = points.where(F.col(c).between(box[f"{c}0"] - radius * WIDER, box[f"{c}1"] + radius * WIDER))


def delta_to_points(features: DataFrame, points: DataFrame, radius: float) -> DataFrame:
    """Each feature's height over the nearest point in space within the radius; of equals the last point."""
    last = [(-F.col("l_orderkey")).alias("a"), (-F.col("l_linenumber")).alias("b")]
    found = nearest_within(features, points, radius, ["feature_id", "class", "z"], last, solid=True)
    return found.select("feature_id", "class", (F.col("z") - F.col("pz")).alias("delta"))


def nearest_height(features: DataFrame, points: DataFrame, half: float) -> DataFrame:
    """The height of the planimetrically nearest point in a square of ``half`` to each side; of equals the first point."""
    return nearest_within(features, points, half, ["feature_id"], ["l_orderkey", "l_linenumber"], square=True).select("feature_id", F.col("pz").alias("z"))


def zonal(zones: DataFrame, points: DataFrame) -> DataFrame:
    """Height statistics of the points in each zone (a frame each), borders included.

    Zones go to all cells of ZONE_CELL that they touch, points to their own: an equi-join, then the exact test.
    """
    span = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / ZONE_CELL), F.floor(F.col(hi) / ZONE_CELL)))
    cells = zones.withColumn("_cx", span("xmin", "xmax")).withColumn("_cy", span("ymin", "ymax"))
    cx, cy = _cell(ZONE_CELL)
    at = points.select("x", "y", "z", cx.alias("_cx"), cy.alias("_cy"))
    inside = (F.col("x") >= F.col("xmin")) & (F.col("x") <= F.col("xmax")) & (F.col("y") >= F.col("ymin")) & (F.col("y") <= F.col("ymax"))
    return at.join(cells, ["_cx", "_cy"]).where(inside).groupBy("zone_id").agg(F.count("*").alias("n"), F.min("z").alias("zmin"), F.max("z").alias("zmax"), F.avg("z").alias("zmean"))


def _node(x0: float, y1: float, gsd: float) -> tuple:
    """Column and row of the nearest node of a grid with its first node at (x0, y1)."""
    return F.floor((F.col("x") - x0) / gsd + 0.5).alias("col"), F.floor((y1 - F.col("y")) / gsd + 0.5).alias("row_")


def delta_to_grid(features: DataFrame, nodes: DataFrame, x0: float, y1: float, gsd: float, least: float) -> DataFrame:
    """Features whose height is ``least`` or more off the grid's; heights of -99 and less are none."""
    at = features.where("z > -99").select("feature_id", "class", "z", *_node(x0, y1, gsd))
    ground = nodes.where("z > -99").select("col", "row_", F.col("z").alias("ground"))
    return at.join(ground, ["col", "row_"]).where(F.abs(F.col("ground") - F.col("z")) >= least).select("feature_id", "class", (F.col("z") - F.col("ground")).alias("delta"))


def first_height(features: DataFrame, stack: DataFrame, x0: float, y1: float, gsd: float) -> DataFrame:
    """stack (dtm, col, row_, z): each feature's height in the first grid that has one there, else null."""
    first = stack.where("z is not null").groupBy("col", "row_").agg(F.min_by("z", "dtm").alias("z"))
    return features.select("feature_id", *_node(x0, y1, gsd)).join(first, ["col", "row_"], "left").select("feature_id", "z")


def touching(zones: DataFrame) -> DataFrame:
    """Pairs (zone_id, other) of frames that touch. Frames meet in cells of ZONE_CELL; the test is then exact."""
    span = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / ZONE_CELL), F.floor(F.col(hi) / ZONE_CELL)))
    cells = zones.select("zone_id", "xmin", "ymin", "xmax", "ymax").withColumn("_cx", span("xmin", "xmax")).withColumn("_cy", span("ymin", "ymax"))
    other = cells.select(*(F.col(c).alias(f"{c}2") if c[0] != "_" else F.col(c) for c in cells.columns))
    met = (F.col("zone_id") != F.col("zone_id2")) & (F.col("xmin") <= F.col("xmax2")) & (F.col("xmax") >= F.col("xmin2")) & (F.col("ymin") <= F.col("ymax2")) & (F.col("ymax") >= F.col("ymin2"))
    return cells.join(other, ["_cx", "_cy"]).where(met).select("zone_id", F.col("zone_id2").alias("other")).distinct()


def _covered(frames: DataFrame, size: float = ZONE_CELL) -> DataFrame:
    """frames (xmin, ymin, xmax, ymax) with a row for each cell that they touch."""
    span = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / size), F.floor(F.col(hi) / size)))
    return frames.withColumn("_cx", span("xmin", "xmax")).withColumn("_cy", span("ymin", "ymax"))


def meeting(frames: DataFrame, others: DataFrame) -> DataFrame:
    """Pairs of rows whose frames touch; the columns of ``others`` get a 2. Frames meet in cells, a pair once, in the cell of its first common corner."""
    right = _covered(others)
    right = right.select(*(F.col(c).alias(c if c[0] == "_" else f"{c}2") for c in right.columns))
    first = (F.col("_cx") == F.floor(F.greatest("xmin", "xmin2") / ZONE_CELL)) & (F.col("_cy") == F.floor(F.greatest("ymin", "ymin2") / ZONE_CELL))
    met = (F.col("xmin") <= F.col("xmax2")) & (F.col("xmax") >= F.col("xmin2")) & (F.col("ymin") <= F.col("ymax2")) & (F.col("ymax") >= F.col("ymin2"))
    return _covered(frames).join(right, ["_cx", "_cy"]).where(met & first).drop("_cx", "_cy")


def in_polygons(points: DataFrame, polygons: DataFrame) -> DataFrame:
    """Points (x, y) inside polygons (ring, closed): pairs of rows, by cells of the rings' frames, then the exact test."""
    side = lambda f, c: f(F.transform("ring", lambda p: p[c]))
    framed = polygons.withColumns({"xmin": side(F.array_min, "x"), "ymin": side(F.array_min, "y"), "xmax": side(F.array_max, "x"), "ymax": side(F.array_max, "y")})
    cx, cy = _cell(ZONE_CELL)
    met = points.withColumn("_cx", cx).withColumn("_cy", cy).join(_covered(framed), ["_cx", "_cy"])
    inside = (F.col("x") >= F.col("xmin")) & (F.col("x") <= F.col("xmax")) & (F.col("y") >= F.col("ymin")) & (F.col("y") <= F.col("ymax"))
    return met.where(inside & (crossings(F.col("x"), F.col("y"), F.col("ring")) % 2 == 1)).drop("_cx", "_cy", "xmin", "ymin", "xmax", "ymax", "ring")


def nearest_of_all(probe: DataFrame, points: DataFrame, key: str, size: float) -> DataFrame:
    """(key, z): the height of each probe's planimetrically nearest point at any distance, of equals the first; no row if there are no points.

    Cells double: what a probe's nine cells hold within one cell's size is its answer, and only probes without one go on.
    """
    span = points.agg(F.max("x") - F.min("x"), F.max("y") - F.min("y")).first()
    ends = probe.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    lows = points.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if span[0] is None or ends[0] is None:
        return probe.join(points.select("z"), F.lit(False)).select(key, "z")
    far = 2 * max(max(ends[1], lows[1]) - min(ends[0], lows[0]), max(ends[3], lows[3]) - min(ends[2], lows[2]), size)
    done, left = None, probe
    order = F.struct("d2", "l_orderkey", "l_linenumber")
    while True:
        pairs = neighbours(left, points.select("x", "y", "z", "l_orderkey", "l_linenumber"), size)
        x, y = F.col("x") - F.col("px"), F.col("y") - F.col("py")
        best = pairs.withColumn("d2", x * x + y * y).groupBy(key).agg(F.min("d2").alias("d2"), F.min_by("pz", order).alias("z"))
        found = (best if size >= far else best.where(F.col("d2") <= size * size)).select(key, "z").persist()
        done = found if done is None else done.union(found)
        left = left.join(found.select(key), key, "left_anti")
        if size >= far or left.isEmpty():
            return done
        size *= 2
