"""Column functions: rounding, frames, distances, rings, terrain, tiles. All stay inside generated code."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS = 6378137.0  # of the Web-Mercator sphere, metres


class Frame(NamedTuple):
    xmin: float
    ymin: float
    xmax: float
    ymax: float


def xrint(c: Column) -> Column:
    """To the nearest whole number, halves up."""
    return F.when(c - F.floor(c) < 0.5, F.floor(c)).otherwise(F.ceil(c)).cast("long")


def in_frame(x: Column, y: Column, f: Frame) -> Column:
    """Touching counts."""
    return (x >= f.xmin) & (x <= f.xmax) & (y >= f.ymin) & (y <= f.ymax)


def grown(f: Frame, k: float) -> Frame:
    """The left side moves by k widths, then the right side by k of the widened width; heights likewise."""
    xmin, ymin = f.xmin - k * (f.xmax - f.xmin), f.ymin - k * (f.ymax - f.ymin)
    return Frame(xmin, ymin, f.xmax + k * (f.xmax - xmin), f.ymax + k * (f.ymax - ymin))


def dist2(ax: Column, ay: Column, bx: Column | float, by: Column | float) -> Column:
    return (ax - bx) * (ax - bx) + (ay - by) * (ay - by)


def in_ring(x: Column, y: Column, ring: list[tuple[float, float]]) -> Column:
    """Inside a closed ring: an odd number of edges cross the ray in direction (1, 1). On u = x - y the ray is a point."""
    inside = F.lit(0)
    for (ax, ay), (bx, by) in zip(ring, ring[1:], strict=False):
        au, bu = ax - ay, bx - by
        if au == bu:
            continue
        u = x - y
        t = (u - au) / (bu - au)
        crosses = (F.lit(au) <= u) != (F.lit(bu) <= u)
        inside = inside + F.when(crosses & (F.lit(ax + ay) + t * (bx + by - ax - ay) > x + y), 1).otherwise(0)
    return inside % 2 == 1


def hillshade(c: Column, north: Column, east: Column, gsd: float, azimuth: float = 135.0, zenith: float = 45.0) -> Column:
    """Cosine between the surface's normal and the light, not under 0. gsd <= 0 means 25 m, under 0.1 degrees."""
    gsd = 25.0 if gsd <= 0 else gsd * 111319.49 if gsd < 0.1 else gsd
    a, z = math.radians(azimuth), math.radians(zenith)
    e, n = (east - c) / gsd, (north - c) / gsd
    return F.greatest(F.lit(0.0), (e * (math.cos(z) * math.sin(a)) + n * (math.cos(z) * math.cos(a)) + math.sin(z)) / F.sqrt(e * e + n * n + 1))


def slope_cosine(c: Column, north: Column, east: Column, gsd: float) -> Column:
    return gsd / F.sqrt((east - c) * (east - c) + (north - c) * (north - c) + gsd * gsd)


def contour_level(c: Column, north: Column, east: Column, step: float) -> Column:
    """The level of a cell that a contour line crosses towards north or east, else null."""
    up = lambda z: F.ceil(z / step)
    return F.when((up(c) != up(north)) | (up(c) != up(east)), F.round(c / step).cast("long"))


def mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Degrees to Web-Mercator metres."""
    return F.radians(lon) * RADIUS, F.log(F.tan(F.radians(lat) / 2 + math.pi / 4)) * RADIUS


def mercator_inverse(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / RADIUS), F.degrees(2 * F.atan(F.exp(y / RADIUS)) - math.pi / 2)


def tile(x: Column, y: Column, zoom: Column | int) -> tuple[Column, Column]:
    """Column and row of the tile of Web-Mercator metres."""
    n = F.pow(F.lit(2.0), zoom if isinstance(zoom, Column) else F.lit(zoom))
    return F.floor((1 + x / (math.pi * RADIUS)) / 2 * n), F.floor((1 - y / (math.pi * RADIUS)) / 2 * n)


def normalised_difference(a: Column, b: Column, offset: float = 1000.0) -> Column:
    """Spectral index; -1 where the denominator is almost zero."""
    below = a + b - 2 * offset
    return F.when(F.abs(below) < 1e-6, F.lit(-1.0)).otherwise((a - b) / below)


def channel(level: Column, low: float, high: float, gamma: float) -> Column:
    """Display value of a raw level: 0 under low, 255 from high, a power curve between, cut to a whole number."""
    return F.when(level < low, 0).when(level >= high, 255).otherwise((F.pow((level - low) / (high - low), gamma) * 255).cast("int"))


def catmull_rom(p0: Column, p1: Column, p2: Column, p3: Column, t: Column | float) -> Column:
    return p1 + 0.5 * t * (p2 - p0 + t * (2 * p0 - 5 * p1 + 4 * p2 - p3 + t * (3 * (p1 - p2) + p3 - p0)))


def terrarium(r: Column, g: Column, b: Column) -> Column:
    return r * 256 + g + b / 256 - 32768


def terrain_rgb(r: Column, g: Column, b: Column) -> Column:
    return (r * 65536 + g * 256 + b) * 0.1 - 10000
