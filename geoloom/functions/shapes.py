"""Column functions over vertices: ``pts`` is an array of structs with x, y and z. They stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from geoloom.functions.geometry import Frame, in_frame, in_ring


def segments(pts: Column) -> Column:
    """Array of (a, b): each vertex with the next."""
    n = F.greatest(F.size(pts) - 1, F.lit(0))
    return F.zip_with(F.slice(pts, F.lit(1), n), F.slice(pts, F.lit(2), n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def cross(a: Column, b: Column, p: Column) -> Column:
    return (b["x"] - a["x"]) * (p["y"] - a["y"]) - (b["y"] - a["y"]) * (p["x"] - a["x"])


def length(pts: Column, with_z: bool = False) -> Column:
    def leg(s: Column) -> Column:
        d = [s["b"][c] - s["a"][c] for c in ("xyz" if with_z else "xy")]
        return F.sqrt(sum((v * v for v in d[1:]), d[0] * d[0]))

    return total(F.transform(segments(pts), leg))


def squared_edges(pts: Column) -> Column:
    """Root of the sum of squared edges."""
    return F.sqrt(total(F.transform(segments(pts), lambda s: (s["b"]["x"] - s["a"]["x"]) * (s["b"]["x"] - s["a"]["x"]) + (s["b"]["y"] - s["a"]["y"]) * (s["b"]["y"] - s["a"]["y"]))))


def area(pts: Column) -> Column:
    """Signed area of the ring that the vertices close: clockwise is positive. Heights are taken from the first vertex."""
    first = pts[0]
    ring = F.concat(pts, F.slice(pts, 1, 1))
    return total(F.transform(segments(ring), lambda s: (s["b"]["x"] - s["a"]["x"]) * (s["b"]["y"] - first["y"] + s["a"]["y"] - first["y"]) / 2))


def centre(pts: Column, c: str) -> Column:
    """Mean of the vertices."""
    return total(F.transform(pts, lambda p: p[c])) / F.size(pts)


def bounds(pts: Column) -> dict[str, Column]:
    values = {c: pts.getField(c) for c in "xy"}  # a field of an array of structs is an array
    return {f"{c}{end}": f(v) for c, v in values.items() for end, f in (("min", F.array_min), ("max", F.array_max))}


def meets_frame(b: dict[str, Column], f: Frame) -> Column:
    """Boxes that touch count."""
    return (b["xmin"] <= f.xmax) & (b["xmax"] >= f.xmin) & (b["ymin"] <= f.ymax) & (b["ymax"] >= f.ymin)


def any_vertex_in_frame(pts: Column, f: Frame) -> Column:
    return F.exists(pts, lambda p: in_frame(p["x"], p["y"], f))


def near_line(pts: Column, x: float, y: float, dist: float) -> Column:
    """Whether a segment's carrier line passes within ``dist`` of the point, inside the segment's box grown by ``dist``."""

    def near(s: Column) -> Column:
        a, b = s["a"], s["b"]
        ex, ey = b["x"] - a["x"], b["y"] - a["y"]
        off = ex * (F.lit(y) - a["y"]) - ey * (F.lit(x) - a["x"])
        box = (F.least(a["x"], b["x"]) - dist <= x) & (F.greatest(a["x"], b["x"]) + dist >= x) & (F.least(a["y"], b["y"]) - dist <= y) & (F.greatest(a["y"], b["y"]) + dist >= y)
        return box & (ex * ex + ey * ey > 0) & (off * off <= dist * dist * (ex * ex + ey * ey))

    return F.exists(segments(pts), near)


def ends_at(pts: Column, x: Column | float, y: Column | float) -> Column:
    """Whether the first or the last vertex is at the point."""
    first, last = pts[0], F.element_at(pts, -1)
    return ((first["x"] == x) & (first["y"] == y)) | ((last["x"] == x) & (last["y"] == y))


def crosses_ring(pts: Column, ring: list[tuple[float, float]]) -> Column:
    """Whether a segment properly crosses an edge of the closed ring."""

    def one(s: Column) -> Column:
        out = F.lit(False)
        for (px, py), (qx, qy) in zip(ring, ring[1:], strict=False):
            p, q = F.struct(F.lit(px).alias("x"), F.lit(py).alias("y")), F.struct(F.lit(qx).alias("x"), F.lit(qy).alias("y"))
            out = out | ((cross(s["a"], s["b"], p) * cross(s["a"], s["b"], q) < 0) & (cross(p, q, s["a"]) * cross(p, q, s["b"]) < 0))
        return out

    return F.exists(segments(pts), one)


def touches_ring(pts: Column, ring: list[tuple[float, float]]) -> Column:
    """A vertex inside, or else a crossing segment."""
    return F.exists(pts, lambda p: in_ring(p["x"], p["y"], ring)) | crosses_ring(pts, ring)


def within_ring(pts: Column, ring: list[tuple[float, float]]) -> Column:
    """All vertices inside and no crossing segment."""
    return F.forall(pts, lambda p: in_ring(p["x"], p["y"], ring)) & ~crosses_ring(pts, ring)


def sample(pts: Column, step: float) -> Column:
    """Points along each segment that is at least ``step`` long: d / step of them, halves up, from its first vertex on."""

    def along(s: Column) -> Column:
        a, b = s["a"], s["b"]
        d = F.sqrt((b["x"] - a["x"]) * (b["x"] - a["x"]) + (b["y"] - a["y"]) * (b["y"] - a["y"]))
        n = F.floor(d / step + 0.5).cast("int")
        put = lambda k: F.struct(*((a[c] + (b[c] - a[c]) * k / n).alias(c) for c in "xy"))
        none = F.array().cast("array<struct<x:double,y:double>>")
        return F.when(d >= step, F.transform(F.sequence(F.lit(0), n - 1), put)).otherwise(none)

    return F.flatten(F.transform(segments(pts), along))
