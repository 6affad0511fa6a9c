"""Selection and visibility of features, and summaries of the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoloom.functions.geometry import Frame, dist2, in_frame, in_ring


def select_features(features: DataFrame, frame: Frame, only_visible: bool = True) -> DataFrame:
    chosen = features.where("selectable").where(in_frame(F.col("x"), F.col("y"), frame))
    return chosen.where("visible") if only_visible else chosen


def find_near(features: DataFrame, x: float, y: float, dist: float) -> DataFrame:
    """Closer than ``dist``; the box first, so that it can be pushed to the scan."""
    box = Frame(x - dist, y - dist, x + dist, y + dist)
    return features.where(in_frame(F.col("x"), F.col("y"), box)).where(dist2(F.col("x"), F.col("y"), x, y) < dist * dist)


def find_closest(features: DataFrame, x: float, y: float) -> DataFrame:
    """The nearest feature; of equals the smallest id. One row a partition meets the last step."""
    return features.withColumn("d2", dist2(F.col("x"), F.col("y"), x, y)).orderBy("d2", "feature_id").limit(1)


def keep_centroid(selected: DataFrame, frame: Frame) -> DataFrame:
    """Features whose centroid is in the frame; if there are none, the selection as it was."""
    inside = in_frame(F.col("x"), F.col("y"), frame)
    some = selected.agg(F.coalesce(F.max(inside), F.lit(False)).alias("some"))  # one row
    return selected.crossJoin(F.broadcast(some)).where(inside | ~F.col("some")).drop("some")


def hide_out_frame(features: DataFrame, frame: Frame) -> DataFrame:
    return features.withColumn("visible", F.col("visible") & in_frame(F.col("x"), F.col("y"), frame))


def hide_out_ring(features: DataFrame, ring: list[tuple[float, float]]) -> DataFrame:
    return features.withColumn("visible", F.col("visible") & in_ring(F.col("x"), F.col("y"), ring))


def class_summary(features: DataFrame) -> DataFrame:
    """Frame, heights and count of each class and of all (class null), in one pass."""
    return features.rollup("class").agg(
        F.min("x").alias("xmin"), F.min("y").alias("ymin"), F.max("x").alias("xmax"), F.max("y").alias("ymax"), F.min("z").alias("zmin"), F.max("z").alias("zmax"), F.count("*").alias("n")
    )


def class_order(features: DataFrame) -> DataFrame:
    """Display order: ascending lowest z-order of the class, then name."""
    low = features.groupBy("class").agg(F.min("zorder").alias("zorder"), F.avg("zorder").alias("mean"))
    return low.withColumn("pos", F.row_number().over(Window.orderBy("zorder", "mean", "class")).cast("long"))  # a row for each class


def top_feature(features: DataFrame, frame: Frame) -> DataFrame:
    """The last feature in display order that is visible in the frame; no row if there is none."""
    seen = features.where("visible").where(in_frame(F.col("x"), F.col("y"), frame))
    return seen.agg(F.max(F.struct("zorder", "feature_id")).alias("top")).where("top is not null").select("top.zorder", "top.feature_id")
