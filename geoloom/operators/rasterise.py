"""Polygons with holes as cells of a raster, by scanlines.

An edge goes to the rows of nodes that it crosses, with the place where it does so; the crossings of a polygon in a row, in order,
bound its spans, and spans become cells. All of it is array functions and one grouping by polygon and row, so a polygon's cells
are made in many tasks, and no cell is held against edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cells(rings: DataFrame, x0: float, y1: float, gsd: float, width: int, height: int) -> DataFrame:
    """rings (feature_id, pts: array of x, y), all rings of a feature counting together -> feature_id, row_, col of the nodes inside, by parity.

    Node (0, 0) lies at x0, y1; rows go down. A ring that does not end where it began is closed; a node on an edge that bounds the polygon on the left is
    inside, one on the right is not; a row belongs to edges that begin in it and not to those that end in it, upwards. Rings of fewer
    than three vertices, and null vertices, give no edges.
    """
    first = F.get("pts", F.lit(0))
    whole = F.concat("pts", F.array(first))  # an edge without length crosses no row
    n = F.size("pts")
    edges = F.arrays_zip(F.slice(whole, F.lit(1), n).alias("a"), F.slice(whole, F.lit(2), n).alias("b"))
    e = rings.where(n >= 3).select("feature_id", F.explode(edges).alias("e")).select("feature_id", *(F.col(f"e.{k}.{c}").alias(f"{c}{k}") for k in "ab" for c in "xy"))
    e = e.where("xa is not null and ya is not null and xb is not null and yb is not null and ya <> yb")
    row = lambda y: (F.lit(y1) - y) / gsd
    # rows whose y is at or above the lower end and below the upper one
    lo, hi = F.floor(row(F.greatest("ya", "yb"))) + 1, F.floor(row(F.least("ya", "yb")))
    lo, hi = F.greatest(lo, F.lit(0).cast("long")), F.least(hi, F.lit(height - 1).cast("long"))
    at = e.where(lo <= hi).select("*", F.explode(F.sequence(lo, hi)).alias("row_"))
    y = F.lit(y1) - F.col("row_") * gsd
    x = F.col("xa") + (y - F.col("ya")) / (F.col("yb") - F.col("ya")) * (F.col("xb") - F.col("xa"))
    met = at.select("feature_id", "row_", x.alias("x")).groupBy("feature_id", "row_").agg(F.array_sort(F.collect_list("x")).alias("x"))
    spans = met.select("feature_id", "row_", F.explode(F.transform(F.sequence(F.lit(0), F.expr("size(x) div 2") - 1), lambda k: F.struct(F.col("x")[2 * k].alias("a"), F.col("x")[2 * k + 1].alias("b")))).alias("s"))
    col = lambda v: F.ceil((v - x0) / gsd)
    left, right = F.greatest(col(F.col("s.a")), F.lit(0).cast("long")), F.least(col(F.col("s.b")) - 1, F.lit(width - 1).cast("long"))
    return spans.where(left <= right).select("feature_id", "row_", F.explode(F.sequence(left, right)).alias("col"))
