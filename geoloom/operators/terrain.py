"""Elevation grids: neighbours, shading, steps, volumes, profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


SIDES = {"east": (0, -1), "west": (0, 1), "south": (-1, 0), "north": (1, 0)}  # from a node to the one of which it is the neighbour on that side


def around(nodes: DataFrame, *sides: str) -> DataFrame:
    """nodes (row_, col, z, ...), each once, with the heights of their neighbours; null where there is none.

    A node goes to its neighbours' places and its own, so one grouping by place does it, and no task holds a row or a column of the grid.
    Rows are dealt out before they are grouped: what a map task reads is not sorted there, five times as large, for a partial result that joins few of them.
    """
    to = [F.struct(F.lit("own").alias("side"), F.col("row_").alias("r"), F.col("col").alias("c"))]
    to += [F.struct(F.lit(s).alias("side"), (F.col("row_") + SIDES[s][0]).alias("r"), (F.col("col") + SIDES[s][1]).alias("c")) for s in sides]
    sent = nodes.select(F.struct(*nodes.columns).alias("node"), F.explode(F.array(*to)).alias("to")).select("node", "to.*")
    own = F.max(F.when(F.col("side") == "own", F.col("node"))).alias("own")
    met = sent.repartition("r", "c").groupBy("r", "c").agg(own, *(F.max(F.when(F.col("side") == s, F.col("node.z"))).alias(s) for s in sides)).where("own is not null")
    return met.select("own.*", *sides)


def with_neighbours(nodes: DataFrame) -> DataFrame:
    """nodes (row_, col, z) with north and east heights; row 0 takes the next row, the last column the one before."""
    found = around(nodes, "east", "west", "south", "north")
    east, north = F.coalesce("east", "west", "z"), F.coalesce("north", "south", "z")
    return found.withColumns({"east": east, "north": north}).drop("west", "south")


def large_steps(nodes: DataFrame, least: float) -> DataFrame:
    """Nodes whose height differs by more than ``least`` from the next node in their row or column."""
    found = around(nodes, "east", "south")
    step = F.greatest(F.abs(F.col("east") - F.col("z")), F.abs(F.col("south") - F.col("z")))
    return found.withColumn("step", step).where(F.col("step") > least).drop("east", "south")


def climb(tracks: DataFrame) -> DataFrame:
    """Running length, climb and descent along each track."""
    order = Window.partitionBy("track_id").orderBy("seq")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    dx, dy, dz = (F.col(c) - F.lag(c).over(order) for c in "xyz")
    legs = tracks.select("track_id", "seq", F.coalesce(F.sqrt(dx * dx + dy * dy), F.lit(0.0)).alias("d"), F.coalesce(dz, F.lit(0.0)).alias("dz"))
    return legs.select("track_id", "seq", F.sum("d").over(upto).alias("length"), F.sum(F.greatest("dz", F.lit(0.0))).over(upto).alias("up"), F.sum(F.least("dz", F.lit(0.0))).over(upto).alias("down"))


def volume(nodes: DataFrame, base: float, gsd: float) -> DataFrame:
    return nodes.agg((F.sum(F.greatest(F.col("z") - base, F.lit(0.0))) * gsd * gsd).alias("volume"), F.count_if(F.col("z") > base).alias("nodes"))


def triangles(nodes: DataFrame) -> DataFrame:
    """Two triangles for each cell of four nodes: corners by column, row and height. A node goes to the four cells that it is a corner of."""
    corner = [F.struct(F.lit(2 * i + j).alias("k"), (F.col("row_") - i).alias("row_"), (F.col("col") - j).alias("col")) for i in (0, 1) for j in (0, 1)]
    sent = nodes.select("z", F.explode(F.array(*corner)).alias("to")).select("z", "to.*")
    four = [F.max(F.when(F.col("k") == k, F.col("z"))).alias(c) for k, c in enumerate(("z", "ze", "zs", "zse"))]
    cell = sent.groupBy("row_", "col").agg(*four).where("z is not null and ze is not null and zs is not null and zse is not null")
    first, second = F.struct(F.lit(0).alias("part"), "z", F.col("zs").alias("z2"), F.col("ze").alias("z3")), F.struct(F.lit(1).alias("part"), F.col("ze").alias("z"), F.col("zs").alias("z2"), F.col("zse").alias("z3"))
    return cell.select("row_", "col", F.explode(F.array(first, second)).alias("t")).select("row_", "col", "t.*")


def affinity(pairs: DataFrame) -> DataFrame:
    """Least squares x' = a x + b y + c and y' = d x + e y + f of (x, y, x2, y2), from sums of one pass."""
    s = pairs.agg(*(F.var_pop(c).alias(f"v{c}") for c in "xy"), F.covar_pop("x", "y").alias("vxy"), *(F.covar_pop(a, b).alias(f"{a}{b}") for a in "xy" for b in ("x2", "y2")), *(F.avg(c).alias(f"m{c}") for c in ("x", "y", "x2", "y2")))
    det = F.col("vx") * F.col("vy") - F.col("vxy") * F.col("vxy")
    a, b = [(F.col(f"x{t}") * F.col("vy") - F.col(f"y{t}") * F.col("vxy")) / det for t in ("x2", "y2")], [(F.col(f"y{t}") * F.col("vx") - F.col(f"x{t}") * F.col("vxy")) / det for t in ("x2", "y2")]
    c = [F.col(f"m{t}") - p * F.col("mx") - q * F.col("my") for t, p, q in zip(("x2", "y2"), a, b, strict=True)]
    return s.select(a[0].alias("a"), b[0].alias("b"), c[0].alias("c"), a[1].alias("d"), b[1].alias("e"), c[1].alias("f"))


def difference(nodes: DataFrame, other: DataFrame) -> DataFrame:
    """Height of one grid less another's, where both have a node."""
    return nodes.select("row_", "col", "z").join(other.select("row_", "col", F.col("z").alias("_z")), ["row_", "col"]).select("row_", "col", (F.col("z") - F.col("_z")).alias("diff"))


def slopes(tracks: DataFrame) -> DataFrame:
    """Run, rise and slope from each vertex to the next; no slope where the run is zero."""
    order = Window.partitionBy("track_id").orderBy("seq")
    dx, dy, dz = (F.lead(c).over(order) - F.col(c) for c in "xyz")
    legs = tracks.select("track_id", "seq", F.sqrt(dx * dx + dy * dy).alias("run"), dz.alias("rise")).where("run is not null")
    return legs.withColumn("slope", F.when(F.col("run") > 0, F.col("rise") / F.col("run")))


def bilinear(features: DataFrame, nodes: DataFrame, x0: float, y1: float, gsd: float) -> DataFrame:
    """Between the four nodes around each feature: weights go to the nodes, so one equi-join and one sum do it; no row unless all four are there."""
    u, v = (F.col("x") - x0) / gsd, (y1 - F.col("y")) / gsd
    at = features.select("feature_id", F.floor(u).alias("c"), F.floor(v).alias("r"), (u - F.floor(u)).alias("a"), (v - F.floor(v)).alias("b"))
    corner = [F.struct((F.col("c") + i).alias("col"), (F.col("r") + j).alias("row_"), ((F.col("a") if i else 1 - F.col("a")) * (F.col("b") if j else 1 - F.col("b"))).alias("w")) for i in (0, 1) for j in (0, 1)]
    four = at.select("feature_id", F.explode(F.array(*corner)).alias("k")).select("feature_id", "k.col", "k.row_", "k.w")
    met = four.join(nodes.select("col", "row_", "z"), ["col", "row_"]).groupBy("feature_id").agg(F.sum(F.col("w") * F.col("z")).alias("shift"), F.count("*").alias("n"))
    return met.where("n = 4").select("feature_id", "shift")
