"""Column functions of images: turned images, tone curves, overviews, resampling weights, cells of point pyramids."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from geoloom.functions.geometry import Frame


@dataclass(frozen=True)
class Turned:
    """An image of ``size`` pixels whose pixel ``origin`` lies at ``centre``, turned by ``angle`` (radians, anticlockwise)."""

    centre: tuple[Column, Column]
    origin: tuple[float, float]
    size: tuple[int, int]
    gsd: float
    angle: Column

    def ground(self, u: Column, v: Column) -> tuple[Column, Column]:
        right, up = u - self.origin[0], self.origin[1] - v
        c, s = F.cos(self.angle), F.sin(self.angle)
        return self.centre[0] + (c * right - s * up) * self.gsd, self.centre[1] + (s * right + c * up) * self.gsd

    def pixel(self, x: Column, y: Column) -> tuple[Column, Column]:
        east, north = x - self.centre[0], y - self.centre[1]
        c, s = F.cos(self.angle), F.sin(self.angle)
        return (c * east + s * north) / self.gsd + self.origin[0], self.origin[1] - (c * north - s * east) / self.gsd

    def frame(self) -> dict[str, Column]:
        """The frame of its four corners."""
        w, h = self.size
        xs, ys = zip(*(self.ground(F.lit(float(u)), F.lit(float(v))) for u in (0, w) for v in (0, h)), strict=True)
        return {"xmin": F.least(*xs), "ymin": F.least(*ys), "xmax": F.greatest(*xs), "ymax": F.greatest(*ys)}


def power_tone(value: Column, around: Column, power: float) -> Column:
    """A value (0 to 1) by its surroundings' mean: dark places are raised, bright ones lowered, the more the farther from the middle."""
    p = F.pow(F.lit(10.0), F.abs(around * 2 - 1) * (power * 0.02))
    return F.when(around >= 0.5, F.pow(value, p)).otherwise(1 - F.pow(1 - value, p))


def linear_tone(value: Column, around: Column, power: float) -> Column:
    """As power_tone, by two straight pieces."""
    p = 1 / (1 + F.exp((around * 2 - 1) * (-power * 0.04)))
    return F.when(value < p, value * (1 - p) / p).otherwise((1 - p) + (value - p) * p / (1 - p))


def overview(wanted: Column, factors: list[int]) -> Column:
    """The largest factor of an image's overviews that is no larger than wanted; 1, the image itself, if all are."""
    return F.coalesce(F.array_max(F.filter(F.array(*map(F.lit, factors)), lambda f: f <= wanted)), F.lit(1))


def corners(u: Column, v: Column, step: float) -> Column:
    """For a pixel of an image whose pixels are ``step`` source pixels wide the four source pixels around its centre: an array of row_, col, weight."""
    across, down = (u + 0.5) * step - 0.5, (v + 0.5) * step - 0.5
    c, r = F.floor(across), F.floor(down)
    a, d = across - c, down - r
    each = [(r + i, c + j, (d if i else 1 - d) * (a if j else 1 - a)) for i in (0, 1) for j in (0, 1)]
    return F.array(*(F.struct(y.alias("row_"), x.alias("col"), w.alias("weight")) for y, x, w in each))


def cell_frame(depth: Column, i: Column, j: Column, corner: tuple[float, float], side: float) -> dict[str, Column]:
    """Ground frame of a cell of a point pyramid whose first level is one cell."""
    size = side / F.pow(F.lit(2.0), depth)
    return {"xmin": corner[0] + i * size, "ymin": corner[1] + j * size, "xmax": corner[0] + (i + 1) * size, "ymax": corner[1] + (j + 1) * size}


def meets(cell: dict[str, Column], frame: Frame) -> Column:
    return (cell["xmin"] <= frame.xmax) & (cell["xmax"] >= frame.xmin) & (cell["ymin"] <= frame.ymax) & (cell["ymax"] >= frame.ymin)


def csv_line(*values: Column) -> Column:
    """Values with two decimals, halves up, between semicolons; null is empty."""
    return F.concat_ws(";", *(F.when(v.isNull(), "").otherwise(F.format_string("%.2f", F.floor(v * 100 + 0.5) / 100.0)) for v in values))
