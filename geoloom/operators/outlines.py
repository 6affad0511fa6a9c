"""Lines and rings: simplified within an error, crossing themselves or each other, a place for their label."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def marked(x: np.ndarray, y: np.ndarray, starts: np.ndarray, ends: np.ndarray, tolerance: float) -> np.ndarray:
    """Which vertices of lines (each from its start to before its end) stay: both ends, and of each stretch the vertex that is farthest from its chord (the first of equals), if over the tolerance.

    All stretches of all lines are split together, a level at a time.
    """
    keep, lo, hi = np.zeros(len(x), bool), starts.astype(np.int64), ends.astype(np.int64) - 1
    keep[lo] = keep[hi] = True
    while len(lo):
        size = np.maximum(hi - lo - 1, 0)
        lo, hi, size = lo[size > 0], hi[size > 0], size[size > 0]
        if not len(lo):
            break
        first, own = np.cumsum(size) - size, np.repeat(np.arange(len(lo)), size)
        at = np.arange(len(own)) - first[own] + lo[own] + 1
        bx, by = (x[hi] - x[lo])[own], (y[hi] - y[lo])[own]
        px, py, square = x[at] - x[lo][own], y[at] - y[lo][own], bx * bx + by * by
        t = np.where(square > 0, np.clip((px * bx + py * by) / np.where(square > 0, square, 1), 0, 1), 0.0)
        far = (px - t * bx) ** 2 + (py - t * by) ** 2
        most = np.maximum.reduceat(far, first)
        top = np.flatnonzero(far == most[own])
        top = top[np.r_[True, own[top][1:] != own[top][:-1]]] if len(top) else top
        top = top[far[top] > tolerance * tolerance]
        k, stretch = at[top], own[top]
        keep[k] = True
        lo, hi = np.r_[lo[stretch], k], np.r_[k, hi[stretch]]
    return keep


def kept(x: np.ndarray, y: np.ndarray, tolerance: float) -> np.ndarray:
    """Places of the vertices of one line that stay."""
    return np.flatnonzero(marked(x, y, np.array([0]), np.array([len(x)]), tolerance))


def generalised(lines: DataFrame, tolerance: float) -> DataFrame:
    """lines (id, pts: array of x, y, ...) -> (id, at, x, y): the vertices that stay, by their places from 0; none that goes is farther than ``tolerance`` from the line that is left.

    A line is a row, so one task has all of it. A line without vertices gives no rows; vertices must not be null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends = b.column("xs").offsets.to_numpy().astype(np.int64)
            x, y = (b.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("xs", "ys"))
            ends -= ends[0]
            at = np.flatnonzero(marked(x, y, ends[:-1], ends[1:], tolerance))
            line = np.searchsorted(ends, at, "right") - 1
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(line)), pa.array((at - ends[line]).astype(np.int32)), pa.array(x[at]), pa.array(y[at])], names=["id", "at", "x", "y"])

    rows = lines.where(F.size("pts") > 0).select("id", F.transform("pts", lambda p: p["x"]).alias("xs"), F.transform("pts", lambda p: p["y"]).alias("ys"))
    return rows.mapInArrow(run, rows.select("id").schema.add("at", "integer").add("x", "double").add("y", "double"))


def segments(lines: DataFrame) -> DataFrame:
    """id, i (from 0), ax, ay, bx, by, last: whether i is the last one of a closed line."""
    n = F.size("pts")
    pair = F.arrays_zip(F.slice("pts", F.lit(1), n - 1).alias("a"), F.slice("pts", F.lit(2), n - 1).alias("b"))
    closed = (F.get("pts", F.lit(0))["x"] == F.element_at("pts", -1)["x"]) & (F.get("pts", F.lit(0))["y"] == F.element_at("pts", -1)["y"])
    rows = lines.where(n >= 2).select("id", closed.alias("closed"), n.alias("n"), F.posexplode(pair).alias("i", "s"))
    return rows.select("id", "i", *(F.col(f"s.{k}.{c}").alias(f"{k}{c}") for k in "ab" for c in "xy"), (F.col("closed") & (F.col("i") == F.col("n") - 2)).alias("last"))


def _cells(size: float) -> Column:
    """The cells of a grid that a segment passes, row by row of cells; a millionth of a cell wider, so that no crossing is lost to rounding."""
    e = size * 1e-6
    down = lambda v: F.floor(v / size)
    rows = F.sequence(down(F.least("ay", "by") - e), down(F.greatest("ay", "by") + e))

    def across(r: Column) -> Column:
        lo, hi = F.greatest(F.least("ay", "by"), r * size - e), F.least(F.greatest("ay", "by"), (r + 1) * size + e)
        at = lambda y: F.when(F.col("ay") == F.col("by"), None).otherwise(F.col("ax") + (y - F.col("ay")) / (F.col("by") - F.col("ay")) * (F.col("bx") - F.col("ax")))
        x = F.coalesce(at(lo), F.col("ax")), F.coalesce(at(hi), F.col("bx"))
        return F.transform(F.sequence(down(F.least(*x) - e), down(F.greatest(*x) + e)), lambda c: F.struct(r.alias("r"), c.alias("c")))

    return F.flatten(F.transform(rows, across))


def crossings(lines: DataFrame, own: bool = True, size: float | None = None) -> DataFrame:
    """Pairs of segments that meet: id, i, id2, j. With ``own`` those of one line (i < j, no neighbours), else those of two (id < id2).

    Segments go to the cells of a grid that they pass (as wide as the mean segment is long, if not given), and only segments of one
    cell are held against each other. Touching counts, and so does lying upon each other.
    """
    s = segments(lines)
    if size is None:
        mean = s.agg(F.avg(F.greatest(F.abs(F.col("ax") - F.col("bx")), F.abs(F.col("ay") - F.col("by"))))).first()[0]
        size = mean or 1.0
    placed = s.withColumn("cell", F.explode(_cells(size)))
    other = placed.select("cell", F.col("id").alias("id2"), F.col("i").alias("j"), *(F.col(c).alias(c.replace("a", "c").replace("b", "d")) for c in ("ax", "ay", "bx", "by")), F.col("last").alias("last2"))
    if own:
        pairs = placed.withColumnRenamed("id", "id2").join(other, ["cell", "id2"]).withColumn("id", F.col("id2")).where((F.col("i") + 1 < F.col("j")) & ~(F.col("last2") & (F.col("i") == 0)))
    else:
        pairs = placed.join(other, "cell").where(F.col("id") < F.col("id2"))
    p = {k: (F.col(f"{k}x"), F.col(f"{k}y")) for k in "abcd"}
    turn = lambda a, b, q: (p[b][0] - p[a][0]) * (p[q][1] - p[a][1]) - (p[b][1] - p[a][1]) * (p[q][0] - p[a][0])
    over = [(F.least(p["a"][k], p["b"][k]) <= F.greatest(p["c"][k], p["d"][k])) & (F.least(p["c"][k], p["d"][k]) <= F.greatest(p["a"][k], p["b"][k])) for k in (0, 1)]
    meet = over[0] & over[1] & (turn("a", "b", "c") * turn("a", "b", "d") <= 0) & (turn("c", "d", "a") * turn("c", "d", "b") <= 0)
    return pairs.where(meet).select("id", "i", "id2", "j").distinct()


def label_points(rings: DataFrame) -> DataFrame:
    """rings (id, pts) -> (id, x, y): the middle of the widest stretch inside the ring (the first of equals) on the line halfway up its frame; the frame's centre where there is none."""
    pts, n = F.col("pts"), F.size("pts")
    ends = lambda c: (F.array_min(F.transform("pts", lambda p: p[c])), F.array_max(F.transform("pts", lambda p: p[c])))
    (x0, x1), (y0, y1) = ends("x"), ends("y")
    rows = rings.where(n > 0).select("id", ((x0 + x1) / 2).alias("cx"), ((y0 + y1) / 2).alias("cy"), F.arrays_zip(pts.alias("a"), F.concat(F.slice(pts, F.lit(2), n), F.slice(pts, F.lit(1), F.lit(1))).alias("b")).alias("e"))
    y = F.col("cy")
    crossed = F.filter("e", lambda e: (e["a"]["y"] <= y) != (e["b"]["y"] <= y))
    at = F.array_sort(F.transform(crossed, lambda e: e["a"]["x"] + (y - e["a"]["y"]) / (e["b"]["y"] - e["a"]["y"]) * (e["b"]["x"] - e["a"]["x"])))
    rows = rows.select("id", "cx", "cy", at.alias("at"))
    spans = F.filter(F.transform("at", lambda v, k: F.struct((F.get("at", k + 1) - v).alias("wide"), (-k).alias("first"), ((F.get("at", k + 1) + v) / 2).alias("x"))), lambda s: (s["first"] % 2 == 0) & s["x"].isNotNull())
    return rows.select("id", F.coalesce(F.array_max(spans)["x"], F.col("cx")).alias("x"), F.col("cy").alias("y"))
