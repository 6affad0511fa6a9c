"""Column functions of rasters, tiles and pyramids: pixels and ground, windows, interpolation, tile ranges, map scales."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from geoloom.functions.geometry import RADIUS, Frame, xrint

PIXEL = 0.00028  # fixed value: metres of a pixel in a tile matrix's scale
COMPOSITES = {"RGB": ("b04", "b03", "b02"), "IRC": ("b08", "b04", "b03"), "URBAN": ("b12", "b11", "b04"), "SWIR": ("b12", "b8a", "b04")}  # fixed values
CHANNELS = ("B01", "B02", "B03", "B04", "B05", "B06", "B07", "B08", "B8A", "B09", "B10", "B11", "B12")  # fixed values


def away(c: Column) -> Column:
    """To the nearest whole number, halves away from zero."""
    return (F.signum(c) * F.floor(F.abs(c) + 0.5)).cast("long")


def to_pixel(x: Column, y: Column, frame: Frame, gsd: float) -> tuple[Column, Column]:
    """Pixel of a ground point; null outside the frame."""
    inside = (x >= frame.xmin) & (x <= frame.xmax) & (y >= frame.ymin) & (y <= frame.ymax)
    return F.when(inside, xrint((x - frame.xmin) / gsd)), F.when(inside, xrint((frame.ymax - y) / gsd))


def to_ground(u: Column, v: Column, frame: Frame, gsd: float) -> tuple[Column, Column]:
    return frame.xmin + u * gsd, frame.ymax - v * gsd


def window(x0: Column, y0: Column, x1: Column, y1: Column, origin: tuple[float, float], gsd: float, size: tuple[int, int], shown: float) -> dict[str, Column]:
    """Of an image with its first corner at ``origin`` the pixels that a frame takes (u, v, w, h) and where they go on a bitmap of ``shown`` metres a pixel (r, s, wr, hs)."""
    left, top = origin
    u, v = F.greatest(F.lit(0), away((x0 - left) / gsd)), F.greatest(F.lit(0), away((top - y1) / gsd))
    u1, v1 = F.least(F.lit(size[0]), away((x1 - left) / gsd)), F.least(F.lit(size[1]), away((top - y0) / gsd))
    r, s = away((u * gsd + left - x0) / shown), away((y1 - (top - v * gsd)) / shown)
    return {"u": u, "v": v, "w": u1 - u, "h": v1 - v, "r": r, "s": s, "wr": away((u1 * gsd + left - x0) / shown) - r, "hs": away((y1 - (top - v1 * gsd)) / shown) - s}


# the offset t of these kernels is a number, or a column: then each row has its own


def nearest(a: Column, b: Column, t: float | Column) -> Column:
    return F.when(F.lit(t) <= 0.5, a).otherwise(b)


def linear(a: Column, b: Column, t: float | Column) -> Column:
    return a + (b - a) * t


def lagrange(p: Column, a: Column, b: Column, c: Column, t: float | Column) -> Column:
    """The cubic through four values at -1, 0, 1, 2."""
    weights = (-t * (t - 1) * (t - 2) / 6, (t + 1) * (t - 1) * (t - 2) / 2, -(t + 1) * t * (t - 2) / 2, (t + 1) * t * (t - 1) / 6)
    return sum((k * w for k, w in zip((p, a, b, c), weights, strict=True)), F.lit(0.0))


def convolution(p: Column, a: Column, b: Column, c: Column, t: float | Column) -> Column:
    """Cubic convolution with a slope of -1 at one pixel's distance."""
    near, far = lambda d: (d - 2) * d * d + 1, lambda d: -((d - 5) * d + 8) * d + 4
    weights = (far(1 + t), near(t), near(1 - t), far(2 - t))
    return sum((k * w for k, w in zip((p, a, b, c), weights, strict=True)), F.lit(0.0))


def twice(kernel, rows: list[list[Column]], t: float, s: float) -> Column:
    """A kernel along rows, then along the column of their values."""
    return kernel(*(kernel(*row, t) for row in rows), s)


def tile_range(x0: Column, y0: Column, x1: Column, y1: Column, zoom: int) -> tuple[Column, Column, Column, Column]:
    """First and last (left out) column and row of the tiles of a Web-Mercator frame."""
    across = lambda c: (1 + c / (RADIUS * math.pi)) / 2 * 2**zoom
    down = lambda c: (1 - c / (RADIUS * math.pi)) / 2 * 2**zoom
    return F.floor(across(x0)), F.ceil(across(x1)), F.floor(down(y1)), F.ceil(down(y0))


def matrix(gsd: Column, scales: list[float]) -> Column:
    """Number of the tile matrix (coarsest first) for a ground sample distance: the first that is no coarser, or the one before it beyond the middle of both."""
    known = [s * PIXEL for s in scales]
    out = F.lit(len(known) - 1)
    for i in range(len(known) - 1, -1, -1):
        chosen = F.when(gsd > (known[i] + known[i - 1]) * 0.5, i - 1).otherwise(i) if i else F.lit(0)
        out = F.when(gsd >= known[i], chosen).otherwise(out)
    return out


def map_zoom(scale: Column) -> Column:
    """Zoom of a web map by scale: 18 less the number of doublings of 2468 that exceed it, from 0 to 17."""
    out = F.lit(0)
    for k in range(17, -1, -1):
        out = F.when(scale / 2468 < 2**k, min(17, 18 - k)).otherwise(out)
    return out


def bisector(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    """Direction from B halfway between those of A and C, from 0 to two pi; null where there is none."""
    d = lambda x, y: F.sqrt((x - bx) * (x - bx) + (y - by) * (y - by))
    u, v = (ax - bx) / d(ax, ay) + (cx - bx) / d(cx, cy), (ay - by) / d(ax, ay) + (cy - by) / d(cx, cy)
    turn = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), u / F.sqrt(u * u + v * v))))
    return F.when((d(ax, ay) > 0) & (d(cx, cy) > 0) & (u * u + v * v > 0), F.when(v >= 0, turn).otherwise(2 * math.pi - turn))


def turned(order: str, omega: Column, phi: Column, kappa: Column, back: bool = False) -> list[list[Column]]:
    """Product of the rotations about x (o), y (p) and z (k) in the order given; ``back`` takes the angles the other way."""
    one, zero = F.lit(1.0), F.lit(0.0)

    def about(axis: str) -> list[list[Column]]:
        a = {"o": omega, "p": phi, "k": kappa}[axis]
        c, s = F.cos(a), F.sin(a) * (-1.0 if back else 1.0)
        return {"o": [[one, zero, zero], [zero, c, -s], [zero, s, c]], "p": [[c, zero, s], [zero, one, zero], [-s, zero, c]], "k": [[c, -s, zero], [s, c, zero], [zero, zero, one]]}[axis]

    first, *rest = map(about, order)
    for m in rest:
        first = [[sum((first[i][k] * m[k][j] for k in range(3)), zero) for j in range(3)] for i in range(3)]
    return first


def scene_name(name: Column) -> Column:
    """Parts of a Sentinel-2 band's file name (zone and tile, date, time, channel, resolution); null if it is none."""
    at = lambda start, n: F.substring(name, start, n)
    good = (F.length(name) >= 30) & (at(7, 1) == "_") & (at(23, 1) == "_") & (at(27, 1) == "_") & at(24, 3).isin(*CHANNELS) & at(28, 3).isin("10m", "20m", "60m")
    return F.when(good, F.struct(at(1, 3).alias("proj"), at(4, 3).alias("tile"), at(8, 8).alias("date"), at(16, 6).alias("id"), at(24, 3).alias("channel"), at(28, 3).alias("resol")))


def crossings(x: Column, y: Column, ring: Column) -> Column:
    """How many edges of a closed ring (an array of x and y) the ray in direction (1, 1) crosses; as ``in_ring`` for a ring that is a column."""
    edges = F.arrays_zip(F.slice(ring, F.lit(1), F.size(ring) - 1).alias("a"), F.slice(ring, F.lit(2), F.size(ring) - 1).alias("b"))
    u, s = x - y, x + y

    def crosses(e: Column) -> Column:
        au, bu, at, bt = e["a"]["x"] - e["a"]["y"], e["b"]["x"] - e["b"]["y"], e["a"]["x"] + e["a"]["y"], e["b"]["x"] + e["b"]["y"]
        return ((au <= u) != (bu <= u)) & (at + (u - au) / (bu - au) * (bt - at) > s)

    return F.size(F.filter(edges, crosses))
