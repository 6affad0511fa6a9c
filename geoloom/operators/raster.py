"""Histograms and display ranges of pixel levels, style filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def histogram(pixels: DataFrame, level: Column) -> DataFrame:
    return pixels.groupBy(level.alias("level")).agg(F.count("*").alias("n"))


def analyse(bins: DataFrame, levels: int = 256) -> DataFrame:
    """First and last used level, used levels, longest gap between used levels. bins has at most ``levels`` rows."""
    gap = F.col("level") - F.lag("level").over(Window.orderBy("level")) - 1
    return bins.where("n > 0").withColumn("gap", gap).agg(F.min("level").alias("first"), F.max("level").alias("last"), F.count("*").alias("used"), F.coalesce(F.max("gap"), F.lit(0)).alias("longest_gap"))


def contrast(bins: DataFrame, drop: float = 0.001) -> DataFrame:
    """Levels that leave out ``drop`` of all pixels at either end. bins has at most 256 rows."""
    run = F.sum("n").over(Window.orderBy("level").rowsBetween(Window.unboundedPreceding, 0))
    part = bins.withColumn("run", run).withColumn("total", F.sum("n").over(Window.partitionBy()))
    return part.agg(F.min(F.when(F.col("run") > drop * F.col("total"), F.col("level"))).alias("low"), F.min(F.when(F.col("run") >= (1 - drop) * F.col("total"), F.col("level"))).alias("high"))


def style_filter(rule: list, attributes: dict[str, Column]) -> Column:
    """A condition from ["all", rule...], ["==", name, value], ["!=", name, value] or ["in", name, value...]; an attribute
    that a feature lacks passes."""
    kind, *rest = rule
    if kind == "all":
        out = F.lit(True)
        for r in rest:
            out = out & style_filter(r, attributes)
        return out
    name, *values = rest
    if kind not in ("==", "!=", "in"):
        raise ValueError(f"no such filter: {kind}")
    found = attributes.get(name, F.lit(None).cast("string"))
    return F.coalesce(~found.isin(values) if kind == "!=" else found.isin(values), F.lit(True))
