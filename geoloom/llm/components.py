"""Connected components of a link table by alternating large and small stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm.common import materialise


def _smallest(links: DataFrame) -> DataFrame:
    """links (u, v) with m, the smallest of u and its neighbours: a combine-side minimum and a join that can be split."""
    least = links.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return links.join(least, "u")


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _smallest(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    near = _smallest(down)
    return near.select(F.col("v").alias("u"), F.col("m").alias("v")).union(near.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """links (u, v) -> (u, root), root the smallest node of u's component; nodes that are their own root are left out."""
    links = materialise(links.where("u <> v").distinct(), "links")
    state = _state(links)
    while state[0]:
        links = materialise(_small_star(_large_star(links)), "links")
        before, state = state, _state(links)
        if before == state:
            break
    return links.select("u", F.col("v").alias("root"))
