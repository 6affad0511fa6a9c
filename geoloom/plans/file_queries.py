"""Queries over files: tables are written in the formats by the tasks that hold them, and read back from the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.operators.shared import folder
from geoloom.plans.map_queries import FRAME
from geoloom.plans.registry import r6, register
from geoloom.sources import cog, copc, las, shapefile, tiff
from geoloom.sources.files import store


@register("las_points", sql=f"SELECT {r6('x y z')}, intensity, classification FROM las_points")
def las_files(points: DataFrame) -> DataFrame:
    """All points as LAS files and back."""
    at = folder(points.sparkSession, "las")
    store(las.write_las(points, 1e-5), at)
    return las.read_las(points.sparkSession, at).select("x", "y", "z", "intensity", "classification")


@register("pt_features", sql=f"SELECT 'point' AS kind, {r6('x y z')}, CAST(feature_id AS VARCHAR) AS feature_id, class FROM pt_features")
def shape_files(features: DataFrame) -> DataFrame:
    """All features as shapefiles with their tables and back."""
    at = folder(features.sparkSession, "shapes")
    attributes = F.create_map(F.lit("id"), F.col("feature_id").cast("string"), F.lit("class"), F.col("class"))
    shapes = features.select(F.lit("point").alias("kind"), F.array(F.lit(0)).alias("parts"), F.array(F.struct("x", "y", "z")).alias("pts"), attributes.alias("attributes"))
    store(shapefile.write_shapefiles(shapes), at)
    p = F.col("pts")[0]
    back = shapefile.read_shapefile(features.sparkSession, at)
    return back.select("kind", p["x"].alias("x"), p["y"].alias("y"), p["z"].alias("z"), F.col("attributes")["id"].alias("feature_id"), F.col("attributes")["class"].alias("class"))


@register("dtm_nodes", sql="SELECT round(x, 6) AS x, round(y, 6) AS y, round(CAST(CAST(z AS FLOAT) AS DOUBLE), 6) AS z FROM dtm_nodes")
def tiff_files(nodes: DataFrame) -> DataFrame:
    """The grid as TIFF files of squares and back; heights have 32 bits there."""
    at = folder(nodes.sparkSession, "tiff")
    store(tiff.write_tiff(nodes, 650000.0, 6861000.0, 50.0, 64), at)
    return tiff.read_tiff(nodes.sparkSession, at).where("value is not null").select("x", "y", F.col("value").alias("z"))


@register("las_points", sql=f"""+ c AS (SELECT las_id, classification % 4 AS level, CAST(floor((x - 650000)/(1000/pow(2, classification % 4))) AS INT) AS i, CAST(floor((y - 6860000)/(1000/pow(2, classification % 4))) AS INT) AS j, CAST(count(*) AS INT) AS n FROM las_points GROUP BY ALL)
    SELECT CAST(las_id AS VARCHAR) AS las_id, level, i, j, n FROM (SELECT *, 1000/pow(2, level) AS s FROM c) WHERE 100/pow(2, level) >= 2e1 AND 650000 + i*s <= {FRAME.xmax} AND 650000 + (i + 1)*s >= {FRAME.xmin} AND 6860000 + j*s <= {FRAME.ymax} AND 6860000 + (j + 1)*s >= {FRAME.ymin}""")  # fmt: skip
def copc_cells(points: DataFrame) -> DataFrame:
    """Each cloud's pyramid as a file of hierarchy pages; of these only pages that may hold cells of the frame, 20 m apart or more, are read."""
    at = folder(points.sparkSession, "copc")
    level = F.col("classification") % 4
    place = lambda c, low: F.floor((F.col(c) - low) / (1000.0 / F.pow(F.lit(2.0), level))).cast("int")
    cells = points.groupBy(F.col("las_id").alias("name"), level.alias("level"), place("x", 650000).alias("x"), place("y", 6860000).alias("y"), F.lit(0).alias("z")).agg(F.count("*").cast("int").alias("point_count"))
    store(copc.write_hierarchies(cells, (650000.0, 6860000.0, 0.0), 1000.0, 100.0, 2), at)
    found = copc.entries(points.sparkSession, at, FRAME, 20.0)
    return found.select(F.regexp_extract("path", r"([^/]+)\.copc\.laz$", 1).alias("las_id"), "level", F.col("x").alias("i"), F.col("y").alias("j"), F.col("point_count").alias("n"))


@register("hills", sql=f"""+ m AS (SELECT row_ // 4 AS row_, col // 4 AS col, CAST(CAST(avg(z) AS FLOAT) AS DOUBLE) AS z FROM (SELECT row_ // 2 * 2 AS row_, col // 2 * 2 AS col, avg(z) AS z FROM hills GROUP BY 1, 2) GROUP BY 1, 2)
    SELECT CAST(4 AS BIGINT) AS factor, 650000 + (col * 4 + 15e-1) * 50 AS x, 6861000 - (row_ * 4 + 15e-1) * 50 AS y, round(z, 3) AS value FROM m
    WHERE 650000 + (col * 4 + 15e-1) * 50 BETWEEN {FRAME.xmin} AND {FRAME.xmax} AND 6861000 - (row_ * 4 + 15e-1) * 50 BETWEEN {FRAME.ymin} AND {FRAME.ymax}""")  # fmt: skip
def cog_overviews(nodes: DataFrame) -> DataFrame:
    """The grid as pyramids of tiles, and of these the pixels of a frame at five nodes a pixel or the next finer level."""
    at = folder(nodes.sparkSession, "cog")
    store(cog.write_cogs(nodes, 650000.0, 6861000.0, 50.0, 32, 4, 3), at)
    found = cog.read_cog(nodes.sparkSession, at, 5.0, FRAME)
    return found.where("value is not null").select("factor", "x", "y", F.round("value", 3).alias("value"))
