"""Drawings in text: MIF with its MID table, DXF entities, world files. A file is one row of Spark's text reader; all else are column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
# fixed values: the words that begin an object of a MIF file
MIF_KINDS = ("none", "point", "line", "pline", "region", "arc", "text", "rect", "roundrect", "ellipse", "multipoint", "collection")
DXF_KINDS = ("POINT", "TEXT", "INSERT", "LINE", "POLYLINE", "LWPOLYLINE")  # fixed values


def _files(spark: SparkSession, path: str, ending: str) -> DataFrame:
    pattern = "*." + "".join(f"[{c}{c.upper()}]" for c in ending)
    return spark.read.text(path, wholetext=True, pathGlobFilter=pattern).select(F.regexp_replace(F.col("_metadata.file_path"), r"\.[^./]*$", "").alias("path"), "value")


def _vertices(text: Column) -> Column:
    pair = F.lit(f"({NUMBER})[ \t,]+({NUMBER})")
    both = F.arrays_zip(F.regexp_extract_all(text, pair, F.lit(1)).alias("x"), F.regexp_extract_all(text, pair, F.lit(2)).alias("y"))
    return F.transform(both, lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y")))


def read_mif(spark: SparkSession, path: str) -> DataFrame:
    """A row per object of each *.mif file: path (without its ending), object, kind, parts (arrays of x and y), attributes (of the *.mid file).

    Points, lines, polylines and regions have parts; objects of other kinds have none, but keep their row of the table. A
    missing table or cell gives null attributes.
    """
    halves = F.split("value", r"(?im)^[ \t]*data[ \t]*\r?$", 2)
    head = _files(spark, path, "mif").select("path", halves[0].alias("head"), F.try_element_at(halves, F.lit(2)).alias("data"))
    listed = F.split(F.regexp_extract("head", r"(?is)\bcolumns\s+\d+[ \t]*\r?\n(.*)$", 1), r"\r?\n")
    names = F.filter(F.transform(listed, lambda c: F.regexp_extract(c, r"^\s*(\S+)", 1)), lambda c: c != "")
    sign = F.regexp_extract("head", r'(?im)^[ \t]*delimiter[ \t]+"(.)"', 1)
    head = head.select("path", "data", names.alias("names"), F.when(sign == "", "\t").otherwise(sign).alias("sign"))
    chunks = F.filter(F.split("data", rf"(?im)^(?=[ \t]*(?:{'|'.join(MIF_KINDS)})\b)"), lambda t: t.rlike(r"\S"))
    each = head.select("path", "names", "sign", F.posexplode(chunks).alias("object", "t")).withColumn("kind", F.lower(F.regexp_extract("t", r"^\s*(\w+)", 1)))
    first, rest = F.regexp_extract("t", r"^[^\r\n]*", 0), F.regexp_replace("t", r"(?m)^[ \t]*[A-Za-z].*$", "")
    body = F.when(F.col("kind").isin("point", "line"), first).when(F.col("kind").isin("pline", "region", "multipoint"), rest).otherwise("")
    parts = F.filter(F.transform(F.split(body, r"(?m)^[ \t]*\d+[ \t]*\r?$"), _vertices), lambda p: F.size(p) > 0)
    four = F.transform(F.regexp_extract_all(first, F.lit(f"({NUMBER})"), F.lit(1)), lambda v: v.cast("double"))
    line = F.array(F.array(*(F.struct(F.get(four, i).alias("x"), F.get(four, i + 1).alias("y")) for i in (0, 2))))
    each = each.withColumn("parts", F.when(F.col("kind") == "line", line).otherwise(parts))
    table = _files(spark, path, "mid").select("path", F.posexplode(F.split("value", r"\r?\n")).alias("object", "row"))
    outside = F.concat(F.lit("\\Q"), F.col("sign"), F.lit('\\E(?=(?:[^"]*"[^"]*")*[^"]*$)'))
    cells = F.split("row", outside, -1)
    valued = F.map_from_arrays("names", F.transform("names", lambda n, i: F.replace(F.get(F.col("cells"), i), F.lit('"'), F.lit(""))))
    return each.join(table, ["path", "object"], "left").withColumn("cells", cells).select("path", "object", "kind", "parts", F.when(F.col("row").isNotNull(), valued).alias("attributes"))


def read_dxf(spark: SparkSession, path: str) -> DataFrame:
    """A row per entity of each *.dxf file's ENTITIES section: path, feature, kind, layer, text, closed, vertices (x, y, z).

    Vertices follow their polyline; a closed one gets its first vertex again at its end if it isn't there; entities of
    other kinds and blocks are left out. A file's pairs are numbered and grouped by windows of that file.
    """
    lines = F.split("value", r"\r?\n")
    count = F.floor(F.size("lines") / 2).cast("int")
    pair = lambda i: F.struct(F.trim(F.get(F.col("lines"), i * 2)).try_cast("int").alias("code"), F.trim(F.get(F.col("lines"), i * 2 + 1)).alias("value"))
    pairs = _files(spark, path, "dxf").select("path", lines.alias("lines")).where(F.size("lines") > 1)
    pairs = pairs.select("path", F.posexplode(F.transform(F.sequence(F.lit(0), count - 1), pair)).alias("pos", "p")).select("path", "pos", "p.code", "p.value")
    order = Window.partitionBy("path").orderBy("pos")
    starts = F.col("code") == 0
    began = F.lag(F.when(starts, F.col("value"))).over(order)
    pairs = pairs.withColumn("named", F.when((F.col("code") == 2) & (began == "SECTION"), F.col("value")))
    pairs = pairs.select(
        "path", "pos", "code", "value", F.last("named", True).over(order).alias("section"), F.last(F.when(starts, F.col("value")), True).over(order).alias("entity"),
        F.sum((starts & ~F.col("value").isin("VERTEX", "SEQEND")).cast("long")).over(order).alias("feature"),
    )
    own = ~F.col("entity").isin("VERTEX", "SEQEND")
    first = lambda code: F.min_by(F.when((F.col("code") == code) & own, F.col("value")), F.when((F.col("code") == code) & own, F.col("pos")))
    placed = F.col("entity") != "POLYLINE"  # its own coordinates are none
    coordinate = lambda *codes: F.max(F.when(F.col("code").isin(*codes), F.col("value").try_cast("double")))
    begins = F.sum((F.col("code").isin(10, 11) & placed).cast("long")).over(order)  # a vertex is its first coordinate and what follows
    each = pairs.where("section = 'ENTITIES'").withColumn("vertex", begins).where(placed & F.col("code").isin(10, 11, 20, 21, 30, 31))
    each = each.groupBy("path", "feature", "vertex").agg(coordinate(10, 11).alias("x"), coordinate(20, 21).alias("y"), coordinate(30, 31).alias("z")).where("x is not null")
    each = each.groupBy("path", "feature").agg(F.transform(F.array_sort(F.collect_list(F.struct("vertex", "x", "y", "z"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), p["z"].alias("z"))).alias("all"))
    made = pairs.where("section = 'ENTITIES'").groupBy("path", "feature").agg(
        first(0).alias("kind"), first(8).alias("layer"), first(1).alias("text"), (F.coalesce(first(70).try_cast("int"), F.lit(0)).bitwiseAND(1) == 1).alias("flag"),
        first(38).try_cast("double").alias("elevation"),
    )
    made = made.where(F.col("kind").isin(*DXF_KINDS)).join(each, ["path", "feature"], "left").withColumn("all", F.coalesce("all", F.array().cast("array<struct<x:double,y:double,z:double>>")))
    made = made.withColumn("all", F.transform("all", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), F.coalesce(p["z"], F.col("elevation")).alias("z"))))
    line = F.col("kind").isin("LINE", "POLYLINE", "LWPOLYLINE")
    count = F.when(line, F.size("all")).otherwise(F.least(F.size("all"), F.lit(1)))
    vertices = F.slice("all", F.lit(1), count)
    made = made.select("path", "feature", "kind", "layer", "text", (F.col("flag") & F.col("kind").isin("POLYLINE", "LWPOLYLINE")).alias("closed"), vertices.alias("v"))
    open_end = F.col("closed") & (F.size("v") > 0) & ~F.get("v", F.lit(0)).eqNullSafe(F.element_at("v", -1))
    return made.select("path", "feature", "kind", "layer", "text", "closed", F.when(open_end, F.concat("v", F.slice("v", 1, 1))).otherwise(F.col("v")).alias("vertices"))


def read_world(spark: SparkSession, path: str, ending: str = "tfw") -> DataFrame:
    """A row per world file: path, gsd_x, gsd_y, x, y (the first pixel's corner; the file gives its centre). Files of other than six numbers are left out."""
    six = F.transform(F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " "), lambda v: v.try_cast("double"))
    rows = _files(spark, path, ending).select("path", six.alias("w")).where((F.size("w") == 6) & F.forall("w", lambda v: v.isNotNull()))
    w = F.col("w")
    return rows.select("path", F.abs(w[0]).alias("gsd_x"), F.abs(w[3]).alias("gsd_y"), (w[4] - w[0] / 2 - w[2] / 2).alias("x"), (w[5] - w[1] / 2 - w[3] / 2).alias("y"))


CAPABILITIES = (
    "Contents struct<Layer: array<struct<Identifier: string, Format: array<string>, TileMatrixSetLink: array<struct<TileMatrixSet: string>>>>,"
    " TileMatrixSet: array<struct<Identifier: string, SupportedCRS: string, TileMatrix: array<struct<Identifier: string, ScaleDenominator: double, TopLeftCorner: string, TileWidth: int, TileHeight: int>>>>>"
)


def read_capabilities(spark: SparkSession, path: str) -> DataFrame:
    """A row per layer and matrix of WMTS capabilities: layer, matrix_set, crs, matrix, scale, corner, tile_width, tile_height."""
    c = _files(spark, path, "xml").select("path", F.from_xml("value", CAPABILITIES, {"ignoreNamespace": "true"})["Contents"].alias("c"))
    layers = c.select("path", F.explode("c.Layer").alias("l")).select("path", F.col("l.Identifier").alias("layer"), F.explode("l.TileMatrixSetLink.TileMatrixSet").alias("matrix_set"))
    sets = c.select("path", F.explode("c.TileMatrixSet").alias("s")).select("path", F.col("s.Identifier").alias("matrix_set"), F.col("s.SupportedCRS").alias("crs"), F.explode("s.TileMatrix").alias("m"))
    return layers.join(sets, ["path", "matrix_set"]).select(
        "layer", "matrix_set", "crs", F.col("m.Identifier").alias("matrix"), F.col("m.ScaleDenominator").alias("scale"), F.col("m.TopLeftCorner").alias("corner"), F.col("m.TileWidth").alias("tile_width"), F.col("m.TileHeight").alias("tile_height")
    )
