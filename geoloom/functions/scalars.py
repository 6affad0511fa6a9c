"""Scalar column functions: vectors, rotations, photographs, names, times, text."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = tuple[Column, Column, Column]


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross3(a: Vector, b: Vector) -> Vector:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def mixed(a: Vector, b: Vector, c: Vector) -> Column:
    return dot(a, cross3(b, c))


def triangle_area(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    return F.abs((bx - ax) * (cy - ay) - (by - ay) * (cx - ax)) / 2


def line_distance(ax: Column, ay: Column, bx: Column, by: Column, px: Column, py: Column) -> Column:
    """From P to the line through A and B; null if they are one point."""
    run = F.sqrt((bx - ax) * (bx - ax) + (by - ay) * (by - ay))
    return F.when(run > 0, F.abs((bx - ax) * (py - ay) - (by - ay) * (px - ax)) / run)


def foot(ax: Column, ay: Column, bx: Column, by: Column, px: Column, py: Column) -> Column:
    """Where the foot of P lies on AB: 0 at A, 1 at B."""
    run = (bx - ax) * (bx - ax) + (by - ay) * (by - ay)
    return F.when(run > 0, ((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / run)


def rotation(omega: Column, phi: Column, kappa: Column) -> list[Vector]:
    """Rows of R = Rx(omega) Ry(phi) Rz(kappa)."""
    so, co, sp, cp, sk, ck = F.sin(omega), F.cos(omega), F.sin(phi), F.cos(phi), F.sin(kappa), F.cos(kappa)
    return [(cp * ck, -cp * sk, sp), (co * sk + so * sp * ck, co * ck - so * sp * sk, -so * cp), (so * sk - co * sp * ck, so * ck + co * sp * sk, co * cp)]


def angles(r: list[Vector]) -> Vector:
    """omega, phi and kappa of such a matrix, for phi between -90 and 90 degrees."""
    return F.atan2(-r[1][2], r[2][2]), F.asin(r[0][2]), F.atan2(-r[0][1], r[0][0])


def quaternion_angles(w: Column, x: Column, y: Column, z: Column) -> Vector:
    """Rotations about x, y and z of a unit quaternion."""
    return F.atan2(2 * (w * x + y * z), 1 - 2 * (x * x + y * y)), F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 2 * (w * y - z * x)))), F.atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z))


def heading(kappa: Column) -> Column:
    """Degrees from north of a photograph with that kappa (radians)."""
    h = 90 - F.degrees(kappa)
    return F.when(h < 0, h + 360).otherwise(h)


def meet(p: Vector, u: Vector, q: Vector, v: Vector) -> Vector:
    """The middle of the shortest link between the rays p + s u and q + t v; null for parallel rays."""
    d = tuple(a - b for a, b in zip(q, p, strict=True))
    n = cross3(u, v)
    below = dot(n, n)
    s, t = mixed(d, v, n) / below, mixed(d, u, n) / below
    return tuple(F.when(below > 0, (p[i] + s * u[i] + q[i] + t * v[i]) / 2) for i in range(3))


def on_plane(p: Vector, u: Vector, z: Column) -> tuple[Column, Column]:
    """Where the ray p + s u meets the height z."""
    s = (z - p[2]) / u[2]
    return p[0] + s * u[0], p[1] + s * u[1]


def project(p: Vector, centre: Vector, r: list[Vector], focal: float) -> tuple[Column, Column]:
    """Image place of a ground point, for a camera at ``centre`` that looks down the third axis of ``r``."""
    d = tuple(a - b for a, b in zip(p, centre, strict=True))
    u, v, w = (dot(row, d) for row in r)
    return -focal * u / w, -focal * v / w


def affine(x: Column, y: Column, k: tuple[float, ...]) -> tuple[Column, Column]:
    a, b, c, d, e, f = k
    return x * a + y * b + c, x * d + y * e + f


def affine_inverse(x: Column, y: Column, k: tuple[float, ...]) -> tuple[Column, Column]:
    a, b, c, d, e, f = k
    det = a * e - b * d
    return ((x - c) * e - (y - f) * b) / det, ((y - f) * a - (x - c) * d) / det


def gps_time(t: Column) -> Column:
    """Adjusted GPS seconds to a timestamp: a thousand million seconds more, from the sixth of January 1980, without leap seconds."""
    return F.timestamp_seconds(t + (1_000_000_000 + 315_964_800))


def hms(seconds: Column) -> Column:
    return F.format_string("%02d:%02d:%02d", F.floor(seconds / 3600), F.floor(seconds / 60) % 60, F.floor(seconds) % 60)


def hms_seconds(packed: Column) -> Column:
    """A time of day as the number HHMMSS to seconds."""
    return F.floor(packed / 10000) * 3600 + F.floor(packed / 100) % 100 * 60 + packed % 100


def file_part(path: Column, part: str) -> Column:
    """folder (with its last slash), name (with extension), stem or extension of a path with either kind of slash."""
    plain = F.replace(path, F.lit("\\"), F.lit("/"))
    pattern = {"folder": r"^(.*/)?[^/]*$", "name": r"([^/]*)$", "stem": r"([^/]*?)(?:\.[^./]*)?$", "extension": r"\.([^./]*)$"}[part]
    return F.regexp_extract(plain, pattern, 1)


XML = {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "'": "&apos;"}  # fixed values


def xml_escape(c: Column) -> Column:
    for plain, escaped in XML.items():
        c = F.replace(c, F.lit(plain), F.lit(escaped))
    return c


def xml_unescape(c: Column) -> Column:
    for plain, escaped in reversed(XML.items()):
        c = F.replace(c, F.lit(escaped), F.lit(plain))
    return c


def natural_key(c: Column, width: int = 20) -> Column:
    """A text that sorts as people do: lower case, numbers padded to ``width`` digits."""
    parts = F.regexp_extract_all(F.lower(c), F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, width, "0")).otherwise(p)), "")


def argb(a: Column, r: Column, g: Column, b: Column) -> Column:
    return (a.cast("long") * 16777216) + r * 65536 + g * 256 + b


def swapped(c: Column) -> Column:
    """The four bytes of a number in the other order."""
    byte = lambda k: F.shiftrightunsigned(c, 8 * k).bitwiseAND(255)
    return byte(0) * 16777216 + byte(1) * 65536 + byte(2) * 256 + byte(3)


def first_attribute(attributes: Column, names: list[str]) -> Column:
    """The value of the first attribute, in order of the map, whose name in lower case is one of ``names``."""
    return F.filter(F.map_entries(attributes), lambda e: F.lower(e["key"]).isin(names))[0]["value"]


def stops(zoom: Column, at: list[tuple[float, float]], linear: bool = False) -> Column:
    """A style value by zoom: that of the last stop reached (the first stop's before it), or in line between two stops."""
    (z0, first), *_ = at
    out = F.lit(float(first))
    for (za, va), (zb, vb) in zip(at, [*at[1:], (math.inf, at[-1][1])], strict=True):
        value = F.lit(float(va)) if not linear or math.isinf(zb) else va + (zoom - za) * ((vb - va) / (zb - za))
        out = F.when(zoom >= za, value).otherwise(out)
    return out


def colour(text: str) -> tuple[int, int, int, float]:
    """Red, green, blue and opacity of #rgb, #rrggbb, rgb() or rgba()."""
    text = text.strip().lower()
    if text.startswith("#"):
        digits = text[1:] if len(text) == 7 else "".join(c + c for c in text[1:])
        return int(digits[:2], 16), int(digits[2:4], 16), int(digits[4:6], 16), 1.0
    if text.startswith("rgb") and text.endswith(")"):
        parts = [p.strip() for p in text[text.index("(") + 1 : -1].split(",")]
        return int(parts[0]), int(parts[1]), int(parts[2]), float(parts[3]) if len(parts) > 3 else 1.0
    raise ValueError(f"no colour: {text}")


def carto_scale(gsd: Column | float, dpi: float) -> Column | float:
    """Denominator of the map scale at ``gsd`` metres a pixel."""
    return gsd / (0.0254 / dpi)


def zoom_for(resolutions: dict[int, float], lat: Column, gsd: Column) -> Column:
    """The first zoom whose ground resolution is under 1.5 gsd, else the largest."""
    out = F.lit(max(resolutions))
    for z in sorted(resolutions, reverse=True):
        out = F.when(resolutions[z] * F.cos(F.radians(lat)) < 1.5 * gsd, F.lit(z)).otherwise(out)
    return out


def palette(z: Column, at: list[tuple[float, tuple[int, int, int]]]) -> tuple[Column, ...]:
    """Red, green and blue in line between thresholds, as whole numbers; the end colours beyond them."""
    return tuple(F.floor(_between(z, [(level, rgb[i]) for level, rgb in at]) + 0.5) for i in range(3))


def _between(z: Column, at: list[tuple[float, float]]) -> Column:
    return stops(z, [(float(a), float(b)) for a, b in at], linear=True)
