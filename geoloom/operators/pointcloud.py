"""Point clouds: clipping, gridding, hole filling, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.functions.geometry import Frame, xrint

ROLLUP_CLASSES = (0, 1, 2, 3, 4, 5, 6, 9, 17, 64, 65, 66, 67)  # fixed values: the classes that have a column


def clip(points: DataFrame, frame: Frame, zmin: float, zmax: float, classes: list[int]) -> DataFrame:
    """Inside the frame, its sides left out; heights with both ends."""
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    return points.where((x > frame.xmin) & (x < frame.xmax) & (y > frame.ymin) & (y < frame.ymax) & z.between(zmin, zmax) & F.col("classification").isin(classes))


def cells(points: DataFrame, gsd: float) -> DataFrame:
    """points with their cell (u, v) on a grid that is snapped outwards to gsd; points past the last cell are left out."""
    extent = points.agg(
        (F.floor(F.min("x") / gsd) * gsd).alias("_x0"), (F.ceil(F.max("y") / gsd) * gsd).alias("_y1"), (F.ceil(F.max("x") / gsd) * gsd).alias("_x1"), (F.floor(F.min("y") / gsd) * gsd).alias("_y0")
    )
    at = points.crossJoin(F.broadcast(extent))  # one row
    at = at.withColumn("u", xrint((F.col("x") - F.col("_x0")) / gsd)).withColumn("v", xrint((F.col("_y1") - F.col("y")) / gsd))
    return at.where((F.col("u") < xrint((F.col("_x1") - F.col("_x0")) / gsd)) & (F.col("v") < xrint((F.col("_y1") - F.col("_y0")) / gsd)))


def grid(points: DataFrame, gsd: float, by: list[str]) -> DataFrame:
    """Count, heights, spread of each cell: partial sums in each task, one shuffle of cells."""
    return cells(points, gsd).groupBy(*by, "u", "v").agg(
        F.count("*").alias("density"), F.min("z").alias("zmin"), F.avg("z").alias("zavg"), F.max("z").alias("zmax"),
        F.coalesce(F.stddev_samp("z"), F.lit(0.0)).alias("zstd"), (F.max("z") - F.min("z")).alias("height"),
    )


def raster(points: DataFrame, gsd: float) -> DataFrame:
    """One row: the last cell (mu, mv) of the grid of ``cells``."""
    side = lambda c: xrint((F.ceil(F.max(c) / gsd) * gsd - F.floor(F.min(c) / gsd) * gsd) / gsd) - 1
    return points.agg(side("x").cast("long").alias("mu"), side("y").cast("long").alias("mv"))


def fill_holes(known: DataFrame, levels: int | None = None, size: DataFrame | None = None) -> DataFrame:
    """known (u, v, z) -> all cells of its rectangle, or up to ``size`` (one row mu, mv); holes get the mean of the smallest
    block of 2 ** k cells that has any. Without ``levels`` there are as many as leave one block.

    A level's mean is that of the level below, so the pyramid shrinks by four each time and a level costs one small shuffle.
    """
    size = known.agg(F.max("u").alias("mu"), F.max("v").alias("mv")) if size is None else size  # one row
    last = size.first()
    wide, high = (0 if last[c] is None else int(last[c]) + 1 for c in ("mu", "mv"))
    levels = max(0, wide - 1, high - 1).bit_length() if levels is None else levels
    every = known.sparkSession.range(wide * high).select(F.expr(f"id div {max(1, high)}").alias("u"), (F.col("id") % max(1, high)).alias("v"))  # made in all tasks
    out, level, z = every.join(known, ["u", "v"], "left"), known, F.col("z")
    for k in range(1, levels + 1):
        half: list[Column] = [F.shiftright(c, 1).alias(c) for c in ("u", "v")]
        level = level.select(*half, "z").groupBy("u", "v").agg(F.avg("z").alias("z"))
        up = level.select(F.col("u").alias(f"u{k}"), F.col("v").alias(f"v{k}"), F.col("z").alias(f"z{k}"))
        out = out.join(up, (F.shiftright("u", k) == F.col(f"u{k}")) & (F.shiftright("v", k) == F.col(f"v{k}")), "left")
        z = F.coalesce(z, F.col(f"z{k}"))
    return out.select("u", "v", z.alias("z"))


def statistics(points: DataFrame) -> DataFrame:
    """A row per class: count and bounds."""
    return points.groupBy("classification").agg(
        F.count("*").alias("n"), F.min("x").alias("xmin"), F.max("x").alias("xmax"), F.min("y").alias("ymin"), F.max("y").alias("ymax"), F.min("z").alias("zmin"), F.max("z").alias("zmax")
    )


def class_rollup(points: DataFrame) -> DataFrame:
    """A row per cloud with a count for each class that has a column, and the others together."""
    c = F.col("classification")
    return points.groupBy("las_id").agg(*(F.count_if(c == k).alias(f"class_{k}") for k in ROLLUP_CLASSES), F.count_if(~c.isin(*ROLLUP_CLASSES)).alias("other"))
