"""Conformal conic and transverse Mercator projections on the GRS80 ellipsoid, as column functions in degrees and metres.

Formulas: J. P. Snyder, Map Projections: A Working Manual (USGS 1395); L. Krueger's series to n ** 3 for the transverse one.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

A, FLAT = 6378137.0, 1 / 298.257222101  # GRS80
E2 = FLAT * (2 - FLAT)
E = math.sqrt(E2)


@dataclass(frozen=True)
class Conic:
    lon0: float
    lat0: float
    south: float
    north: float
    east: float  # false easting
    up: float  # false northing

    def constants(self) -> tuple[float, float, float]:
        m = lambda p: math.cos(p) / math.sqrt(1 - E2 * math.sin(p) ** 2)
        t = lambda p: math.tan(math.pi / 4 - p / 2) / ((1 - E * math.sin(p)) / (1 + E * math.sin(p))) ** (E / 2)
        s, n, o = (math.radians(v) for v in (self.south, self.north, self.lat0))
        k = (math.log(m(s)) - math.log(m(n))) / (math.log(t(s)) - math.log(t(n)))
        f = A * m(s) / (k * t(s) ** k)
        return k, f, f * t(o) ** k


LAMBERT93 = Conic(3, 46.5, 44, 49, 700_000, 6_600_000)


def conic_zone(lat: int) -> Conic:
    """The nine-zone conic of that parallel, 42 to 50."""
    return Conic(3, lat, lat - 0.75, lat + 0.75, 1_700_000, 200_000 + (lat - 41) * 1_000_000)


def conic(lon: Column, lat: Column, p: Conic) -> tuple[Column, Column]:
    k, f, r0 = p.constants()
    phi = F.radians(lat)
    es = E * F.sin(phi)
    r = f * F.pow(F.tan(math.pi / 4 - phi / 2) / F.pow((1 - es) / (1 + es), F.lit(E / 2)), F.lit(k))
    theta = k * F.radians(lon - p.lon0)
    return p.east + r * F.sin(theta), p.up + r0 - r * F.cos(theta)


def conic_inverse(x: Column, y: Column, p: Conic) -> tuple[Column, Column]:
    k, f, r0 = p.constants()
    dx, dy = x - p.east, r0 - (y - p.up)
    t = F.pow(F.sqrt(dx * dx + dy * dy) / f, F.lit(1 / k))
    return F.degrees(F.atan2(dx, dy) / k) + p.lon0, F.degrees(_latitude(math.pi / 2 - 2 * F.atan(t)))


def _latitude(conformal: Column) -> Column:
    """Geodetic from conformal latitude by the series in e (Snyder 3-5)."""
    e2, e4, e6, e8 = E2, E2**2, E2**3, E2**4
    terms = [e2 / 2 + 5 * e4 / 24 + e6 / 12 + 13 * e8 / 360, 7 * e4 / 48 + 29 * e6 / 240 + 811 * e8 / 11520, 7 * e6 / 120 + 81 * e8 / 1120, 4279 * e8 / 161280]
    out = conformal
    for i, c in enumerate(terms, 1):
        out = out + c * F.sin(2 * i * conformal)
    return out


_N = FLAT / (2 - FLAT)
_RADIUS = A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
SCALE, FALSE_EAST = 0.9996, 500_000.0


def utm(lon: Column, lat: Column, zone: int, south: bool = False) -> tuple[Column, Column]:
    phi, lam = F.radians(lat), F.radians(lon - (6 * zone - 183))
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - E * F.atanh(E * s))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return FALSE_EAST + SCALE * _RADIUS * east, (10_000_000.0 if south else 0.0) + SCALE * _RADIUS * north


def utm_inverse(x: Column, y: Column, zone: int, south: bool = False) -> tuple[Column, Column]:
    xi0, eta0 = (y - (10_000_000.0 if south else 0.0)) / (SCALE * _RADIUS), (x - FALSE_EAST) / (SCALE * _RADIUS)
    xi, eta = xi0, eta0
    for j, b in enumerate(_BETA, 1):
        xi = xi - b * F.sin(2 * j * xi0) * F.cosh(2 * j * eta0)
        eta = eta - b * F.cos(2 * j * xi0) * F.sinh(2 * j * eta0)
    return F.degrees(F.atan2(F.sinh(eta), F.cos(xi))) + (6 * zone - 183), F.degrees(_latitude(F.asin(F.sin(xi) / F.cosh(eta))))
