"""The catalog of features: lookups, selections as sets, display order, frames, resolutions, robust fits."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.operators import terrain
from geoloom.operators.shared import Written

KEPT = 10

def find_attribute(features: DataFrame, name: str, column: str, value: str) -> DataFrame:
    """The first feature in display order of the class, whatever its letter case, whose attribute has the value."""
    return features.where((F.lower("class") == name.lower()) & (F.col(column).cast("string") == value)).orderBy("zorder", "feature_id").limit(1)


def add(selection: DataFrame, more: DataFrame) -> DataFrame:
    return selection.unionByName(more).distinct()


def remove(selection: DataFrame, less: DataFrame, key: str) -> DataFrame:
    return selection.join(less, key, "left_anti")


def reorder(order: DataFrame, old: int, new: int) -> DataFrame:
    """order (pos from 0, ...): one entry moves before the place ``new``, or to the end if that is negative."""
    last = order.agg(F.count("*").alias("_n"))  # one row
    target = F.when(F.lit(new) < 0, F.col("_n") - 1).when(F.lit(new) > old, F.lit(new - 1)).otherwise(F.lit(new))
    moved = F.when(F.col("pos") == old, target).when((F.col("pos") > old) & (F.col("pos") <= target), F.col("pos") - 1).when((F.col("pos") < old) & (F.col("pos") >= target), F.col("pos") + 1).otherwise(F.col("pos"))
    return order.crossJoin(F.broadcast(last)).withColumn("pos", moved.cast("long")).drop("_n")


def base_frame(features: DataFrame) -> DataFrame:
    """The frame of all features, grown by a twentieth; sides over 1000 m are moved outwards to tens of metres."""
    f = features.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    w, h = (F.col("x1") - F.col("x0")) * 0.05, (F.col("y1") - F.col("y0")) * 0.05
    f = f.select((F.col("x0") - w).alias("x0"), (F.col("x1") + w).alias("x1"), (F.col("y0") - h).alias("y0"), (F.col("y1") + h).alias("y1"))
    big = (F.col("x1") - F.col("x0") > 1000) | (F.col("y1") - F.col("y0") > 1000)
    low, high = (lambda c: F.when(big, F.floor(F.col(c) / 10) * 10.0).otherwise(F.col(c))), (lambda c: F.when(big, F.ceil(F.col(c) / 10) * 10.0).otherwise(F.col(c)))
    return f.select(low("x0").alias("xmin"), high("x1").alias("xmax"), low("y0").alias("ymin"), high("y1").alias("ymax"))


def robust_affinity(pairs: DataFrame, worst: float = 3.0) -> DataFrame:
    """A fit whose worst pair is left out while its residual is over ``worst`` times the mean; with n and the residuals' rms.

    A round is one aggregate for the fit and one for its residuals; only these single rows reach the driver. Residuals that
    are only rounding (1e-9 of the largest coordinate) end it too. The pairs are written first and, without what was left out, every
    KEPT rounds; all rounds since then are one filter on that table, as filters upon filters make the optimiser's work double in each.
    """
    spark, made, left_in = pairs.sparkSession, Written(pairs.sparkSession), []
    held = pairs = made(pairs, "pairs")
    while True:
        fit = terrain.affinity(pairs).first()
        dx = F.col("x") * fit["a"] + F.col("y") * fit["b"] + fit["c"] - F.col("x2")
        dy = F.col("x") * fit["d"] + F.col("y") * fit["e"] + fit["f"] - F.col("y2")
        res = F.sqrt(dx * dx + dy * dy)
        large = F.max(F.greatest(F.abs("x"), F.abs("y"), F.abs("x2"), F.abs("y2"))).alias("large")
        found = pairs.agg(F.max(res).alias("worst"), F.avg(res).alias("mean"), F.count("*").alias("n"), F.sqrt(F.avg(res * res)).alias("rms"), large).first()
        if found["n"] <= 3 or found["worst"] <= max(worst * found["mean"], 1e-9 * found["large"]):
            break
        left_in.append(res < found["worst"])
        pairs = held.where(reduce(and_, left_in))
        if len(left_in) == KEPT:
            held = pairs = made(pairs, "pairs")
            made.drop(keep=1)
            left_in = []
    made.drop()
    return spark.createDataFrame([(*fit, found["n"], found["rms"])], "a double, b double, c double, d double, e double, f double, n long, rms double")
