"""Line features: built from points, measured, selected, hidden, sampled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.functions import shapes as S
from geoloom.functions.geometry import Frame


def build(points: DataFrame, by: str = "l_orderkey", order: str = "l_linenumber") -> DataFrame:
    """(id, pts): a line's own vertices in order; of equal places by x, y, z. A line is one row, so it must fit in one."""
    held = F.array_sort(F.collect_list(F.struct(order, "x", "y", "z")))
    return points.groupBy(F.col(by).alias("id")).agg(F.transform(held, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), p["z"].alias("z"))).alias("pts"))


def measures(lines: DataFrame) -> DataFrame:
    p = F.col("pts")
    return lines.select(
        "id", F.size(p).cast("long").alias("n"), S.length(p).alias("length"), S.length(p, True).alias("length3d"), S.area(p).alias("area"),
        S.squared_edges(p).alias("edges"), S.centre(p, "x").alias("cx"), S.centre(p, "y").alias("cy"),
    )


def select_lines(lines: DataFrame, frame: Frame) -> DataFrame:
    """Box against frame first, then a vertex in it."""
    p = F.col("pts")
    return lines.where(S.meets_frame(S.bounds(p), frame)).where(S.any_vertex_in_frame(p, frame))


def hide_out(lines: DataFrame, ring: list[tuple[float, float]], strict: bool = False) -> DataFrame:
    """The lines that stay visible: those that touch the ring; ``strict``: those wholly inside."""
    return lines.where((S.within_ring if strict else S.touches_ring)(F.col("pts"), ring))


def sample(lines: DataFrame, step: float) -> DataFrame:
    """(id, k, x, y): points along each line, ``step`` apart as nearly as whole numbers allow."""
    return lines.select("id", F.posexplode(S.sample(F.col("pts"), step)).alias("k", "p")).select("id", "k", "p.x", "p.y")


FRAMES = 60 * 20  # pictures a second, seconds of the film


def fly_path(lines: DataFrame, zmin: float, zmax: float) -> DataFrame:
    """(id, seg, k, x, y, z): where a flight along each line is at each picture: places a whole number of metres apart on each segment, from its first vertex on.

    The step is the line's length in FRAMES parts, at least one metre; a segment counts as a metre long at least. Heights under zmin, or missing,
    are taken halfway between zmin and zmax. A line of one vertex has no path.
    """
    whole = lambda v: F.greatest(F.floor(v + 0.5), F.lit(1)).cast("long")
    height = lambda z: F.when(z >= zmin, z).otherwise((zmin + zmax) * 0.5)
    rows = lines.where(F.size("pts") >= 2).select("id", whole(S.length(F.col("pts")) / FRAMES).alias("step"), F.posexplode(S.segments(F.col("pts"))).alias("seg", "s"))
    a, b = F.col("s.a"), F.col("s.b")
    far = whole(F.sqrt((b["x"] - a["x"]) * (b["x"] - a["x"]) + (b["y"] - a["y"]) * (b["y"] - a["y"])))
    rows = rows.withColumn("far", far).select("id", "seg", "s", "far", F.explode(F.sequence(F.lit(0).cast("long"), F.col("far") - 1, F.col("step"))).alias("k"))
    at = lambda p, q: (p * (F.col("far") - F.col("k")) + q * F.col("k")) / F.col("far")
    return rows.select("id", "seg", "k", at(a["x"], b["x"]).alias("x"), at(a["y"], b["y"]).alias("y"), at(height(a["z"]), height(b["z"])).alias("z"))


def by_size(lines: DataFrame) -> DataFrame:
    """Descending by width plus height of the frame, then id."""
    b = S.bounds(F.col("pts"))
    return lines.select("id", (b["xmax"] - b["xmin"] + b["ymax"] - b["ymin"]).alias("size")).orderBy(F.col("size").desc(), "id")
