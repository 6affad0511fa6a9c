"""Text formats: GeoJSON, points in CSV, elevation grids in ASC; writers of GeoJSON features and ASC rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GEOJSON = "features array<struct<geometry:string,properties:map<string,string>>>"


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """A row per feature: path, feature, kind, coordinates (JSON text, as depth differs by kind), properties, geographic.

    geographic: whether all numbers of the file's first feature lie within 180 of zero.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.from_json("value", GEOJSON).alias("f"))
    numbers = F.regexp_extract_all(F.get_json_object(F.col("f.features")[0]["geometry"], "$.coordinates"), F.lit(r"(-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)"), F.lit(1))
    guess = F.forall(numbers, lambda v: F.abs(v.cast("double")) <= 180)
    each = files.select("path", guess.alias("geographic"), F.posexplode("f.features").alias("feature", "f"))
    return each.select("path", "feature", F.get_json_object("f.geometry", "$.type").alias("kind"), F.get_json_object("f.geometry", "$.coordinates").alias("coordinates"), F.col("f.properties").alias("properties"), "geographic")


def geojson_feature(kind: Column, coordinates: Column, properties: Column) -> Column:
    """A GeoJSON feature as text; coordinates are arrays of numbers of any depth."""
    geometry = F.struct(kind.alias("type"), coordinates.alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties")))


def read_points(spark: SparkSession, path: str, x: int, y: int, z: int | None = None, sep: str = ";", skip: int = 0) -> DataFrame:
    """Points from columns (counted from 0) of text files; the first ``skip`` lines of each file and lines without numbers are left out."""
    lines = spark.read.text(path, wholetext=True) if skip else spark.read.text(path)
    if skip:
        rows = F.split("value", "\r?\n")
        lines = lines.select(F.explode(F.slice(rows, F.lit(skip + 1), F.greatest(F.size(rows) - skip, F.lit(0)))).alias("value"))
    cell = F.split("value", f"\\Q{sep}\\E")
    number = lambda k: F.try_element_at(cell, F.lit(k + 1)).try_cast("double")
    return lines.select(number(x).alias("x"), number(y).alias("y"), (F.lit(None).cast("double") if z is None else number(z)).alias("z")).where("x is not null and y is not null")


def read_asc(spark: SparkSession, path: str) -> DataFrame:
    """A row per node of each grid: path, row_, col, x, y (of the cell's centre), z (null for no data)."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.lower("value").alias("t"))
    of = lambda key: F.regexp_extract("t", rf"(?m)^\s*{key}\s+(\S+)", 1).try_cast("double")
    corner = lambda c: F.coalesce(of(f"{c}llcorner") + of("cellsize") / 2, of(f"{c}llcenter"))
    rows = F.filter(F.split("t", "\r?\n"), lambda r: r.rlike(r"^\s*[-+.\d]"))
    grid = files.select("path", corner("x").alias("x0"), corner("y").alias("y0"), of("cellsize").alias("gsd"), of("nrows").alias("n"), F.coalesce(of("nodata_value"), F.lit(-9999.0)).alias("none"), F.posexplode(rows).alias("row_", "line"))
    node = grid.select("*", F.posexplode(F.split(F.trim("line"), r"\s+")).alias("col", "v")).withColumn("v", F.col("v").try_cast("double"))
    return node.select("path", "row_", "col", (F.col("x0") + F.col("col") * F.col("gsd")).alias("x"), (F.col("y0") + (F.col("n") - 1 - F.col("row_")) * F.col("gsd")).alias("y"), F.when(F.col("v") != F.col("none"), F.col("v")).alias("z"))


def asc_lines(nodes: DataFrame, x0: float, y0: float, gsd: float, none: int = -9999, places: int = 2) -> DataFrame:
    """nodes (row_, col, z) of a grid whose first node lies at x0, y0 -> (line, value): the lines of an ASC file in order, the six of its head first.

    Rows and columns run from 0 to the largest there are; heights have ``places`` decimals, halves up; places without a height
    hold ``none``. A line is one row of the grid.
    """
    size = nodes.agg(F.max("row_").alias("h"), F.max("col").alias("w"))  # one row
    text = F.format_string(f"%.{places}f", F.floor(F.col("z") * 10**places + 0.5) / float(10**places))
    cells = nodes.where("z is not null").groupBy("row_").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("col", text.alias("t"))))).alias("m"))
    every = size.where("h is not null").select("w", F.explode(F.sequence(F.lit(0).cast("long"), F.col("h").cast("long"))).alias("row_"))
    cell = lambda c: F.coalesce(F.try_element_at("m", c), F.lit(str(none)))
    rows = every.join(cells, "row_", "left").select((F.col("row_") + 6).alias("line"), F.array_join(F.transform(F.sequence(F.lit(0).cast(nodes.schema["col"].dataType), F.col("w")), cell), " ").alias("value"))
    corner = lambda v: F.format_string("%.3f", v)
    head = {"ncols": (F.col("w") + 1).cast("string"), "nrows": (F.col("h") + 1).cast("string"), "xllcenter": corner(F.lit(x0)), "yllcenter": corner(y0 - F.col("h") * gsd), "cellsize": corner(F.lit(gsd)), "nodata_value": F.lit(str(none))}
    lines = F.array(*(F.concat(F.lit(f"{k} "), v) for k, v in head.items()))
    return size.where("h is not null").select(F.posexplode(lines).alias("line", "value")).select(F.col("line").cast("long"), "value").unionByName(rows)
