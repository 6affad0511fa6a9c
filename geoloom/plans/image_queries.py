"""Queries of turned and resampled images, point pyramids, catalogs over time and text of features, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoloom.functions import images
from geoloom.plans.map_queries import FRAME
from geoloom.plans.registry import register
from geoloom.sources import text

_GROUND = "(xmin + xmax)/2 + (cos(a)*({u} - 50) - sin(a)*(40 - {v}))*2 x, (ymin + ymax)/2 + (sin(a)*({u} - 50) + cos(a)*(40 - {v}))*2 y"


@register("zones", sql="+ t AS (SELECT zone_id, xmin, ymin, xmax, ymax, zone_id / 1e1 a FROM zones), p AS (" + " UNION ALL ".join(f"SELECT zone_id, {_GROUND.format(u=u, v=v)} FROM t" for u in (0, 100) for v in (0, 80)) + """),
    f AS (SELECT zone_id, min(x) x0, min(y) y0, max(x) x1, max(y) y1 FROM p GROUP BY 1), d AS (SELECT zone_id, a, (xmin - xmax)/2 e, (ymin - ymax)/2 n FROM t)
    SELECT zone_id, round(x0, 6) xmin, round(y0, 6) ymin, round(x1, 6) xmax, round(y1, 6) ymax, round((cos(a)*e + sin(a)*n)/2 + 50, 6) u, round(40 - (cos(a)*n - sin(a)*e)/2, 6) v FROM f JOIN d USING (zone_id)""")  # fmt: skip
def rotated_image(zones: DataFrame) -> DataFrame:
    """Frame of an image turned about each zone's middle, and the pixel at the zone's first corner."""
    middle = (F.col("xmin") + F.col("xmax")) / 2, (F.col("ymin") + F.col("ymax")) / 2
    image = images.Turned(middle, (50.0, 40.0), (100, 80), 2.0, F.col("zone_id") / 10.0)
    u, v = image.pixel(F.col("xmin"), F.col("ymin"))
    return zones.select("zone_id", *(c.alias(n) for n, c in image.frame().items()), u.alias("u"), v.alias("v"))


@register("pixels", sql="""+ v AS (SELECT scene, pixel, b03 / 1e4 a, b04 / 1e4 m FROM pixels), p AS (SELECT *, pow(1e1, abs(m*2 - 1)*50*2e-2) e, 1/(1 + exp((m*2 - 1)*-50*4e-2)) q FROM v)
    SELECT scene, pixel, round(CASE WHEN m >= 5e-1 THEN pow(a, e) ELSE 1 - pow(1 - a, e) END, 6) power, round(CASE WHEN a < q THEN a*(1 - q)/q ELSE (1 - q) + (a - q)*q/(1 - q) END, 6) linear FROM p""")  # fmt: skip
def tone_curves(pixels: DataFrame) -> DataFrame:
    value, around = F.col("b03") / 10000.0, F.col("b04") / 10000.0
    return pixels.select("scene", "pixel", images.power_tone(value, around, 50.0).alias("power"), images.linear_tone(value, around, 50.0).alias("linear"))


@register("pt_features", sql="SELECT feature_id, CASE WHEN w >= 16 THEN 16 WHEN w >= 8 THEN 8 WHEN w >= 4 THEN 4 WHEN w >= 2 THEN 2 ELSE 1 END AS factor FROM (SELECT feature_id, feature_id % 80 / 4e0 w FROM pt_features)")
def overview_choice(features: DataFrame) -> DataFrame:
    return features.select("feature_id", images.overview(F.col("feature_id") % 80 / 4.0, [2, 4, 8, 16]).alias("factor"))


@register("dtm_nodes", sql="""+ size AS (SELECT max(row_) + 1 h FROM dtm_nodes), g AS (SELECT u, v, (u + 5e-1)*4e-1 - 5e-1 x, (v + 5e-1)*4e-1 - 5e-1 y FROM range(50) a(u), (SELECT unnest(range(CAST(ceil(h * 25e-1) AS BIGINT))) v FROM size)),
    k AS (SELECT u, v, CAST(floor(x) AS BIGINT) + j col, CAST(floor(y) AS BIGINT) + i row_, CASE WHEN j = 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END * CASE WHEN i = 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END w FROM g, range(2) p(i), range(2) q(j))
    SELECT u, v, CAST(CASE WHEN count(z) < 4 THEN 255 ELSE least(255, greatest(0, floor(round(sum(w * z), 6) + 5e-1))) END AS INT) AS value FROM k LEFT JOIN dtm_nodes n ON n.row_ = k.row_ AND n.col = k.col GROUP BY 1, 2""")  # fmt: skip
def resample_linear(nodes: DataFrame) -> DataFrame:
    """The grid at two and a half times its resolution by the linear kernel; pixels without all four neighbours are white.

    Rows of pixels come from a range of ids over the grid's height, so they are made in all tasks; pixels and nodes meet by an equi-join.
    """
    height = nodes.agg(F.max("row_")).first()[0]
    size = -(-(height + 1) * 5 // 2) if height is not None else 0
    rows = nodes.sparkSession.range(size).select(F.col("id").alias("v"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(49).cast("long"))).alias("u"))
    around = rows.select("u", "v", F.explode(images.corners(F.col("u"), F.col("v"), 0.4)).alias("c")).select("u", "v", "c.*")
    met = around.join(nodes.select("row_", "col", "z"), ["row_", "col"], "left").groupBy("u", "v").agg(F.count("z").alias("n"), F.sum(F.col("weight") * F.col("z")).alias("z"))
    value = F.least(F.lit(255), F.greatest(F.lit(0), F.floor(F.round("z", 6) + 0.5)))
    return met.select("u", "v", F.when(F.col("n") < 4, 255).otherwise(value).cast("int").alias("value"))


@register("las_points", sql="""+ e AS (SELECT las_id, classification AS depth, intensity AS place, count(*) n FROM las_points GROUP BY 1, 2, 3)
    SELECT las_id, depth, place, n, CAST(sum(n) OVER (PARTITION BY las_id ORDER BY place, depth) - n AS BIGINT) AS first FROM e""")  # fmt: skip
def entry_points(points: DataFrame) -> DataFrame:
    """Number of the first point of each entry of a file's pyramid, entries in the order of their places (points before them only; adding the entry's own number too would skip points)."""
    entries = points.groupBy("las_id", F.col("classification").alias("depth"), F.col("intensity").alias("place")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("las_id").orderBy("place", "depth")) - F.col("n")
    return entries.select("las_id", "depth", "place", "n", before.alias("first"))


@register("las_points", sql=f"""+ c AS (SELECT DISTINCT classification % 4 AS depth, CAST(floor((x - 650000)/(1000/pow(2, classification % 4))) AS BIGINT) i, CAST(floor((y - 6860000)/(1000/pow(2, classification % 4))) AS BIGINT) j FROM las_points)
    SELECT depth, i, j FROM (SELECT *, 1000/pow(2, depth) s FROM c) WHERE 650000 + i*s <= {FRAME.xmax} AND 650000 + (i + 1)*s >= {FRAME.xmin} AND 6860000 + j*s <= {FRAME.ymax} AND 6860000 + (j + 1)*s >= {FRAME.ymin}""")  # fmt: skip
def cells_in_frame(points: DataFrame) -> DataFrame:
    """Cells of the pyramid that meet a frame: what a reader would fetch."""
    depth = F.col("classification") % 4
    size = 1000.0 / F.pow(F.lit(2.0), depth)
    cells = points.select(depth.alias("depth"), F.floor((F.col("x") - 650000) / size).alias("i"), F.floor((F.col("y") - 6860000) / size).alias("j")).distinct()
    return cells.where(images.meets(images.cell_frame(F.col("depth"), F.col("i"), F.col("j"), (650000.0, 6860000.0), 1000.0), FRAME))


@register("tracks", sql="""+ gone AS (SELECT track_id, kind, max(CASE WHEN seq % 5 = 0 THEN seq END) last FROM tracks GROUP BY 1, 2), born AS (
    SELECT t.track_id, t.kind, min(t.seq) since FROM tracks t JOIN gone g ON t.track_id = g.track_id AND t.kind = g.kind WHERE g.last IS NULL OR t.seq > g.last GROUP BY 1, 2)
    SELECT track_id, kind AS layer, since, row_number() OVER (PARTITION BY track_id ORDER BY since) AS zorder FROM born""")  # fmt: skip
def catalog_layers(events: DataFrame) -> DataFrame:
    """Layers of each base after all its additions (found or created, last in order) and removals (each fifth event); zorder counts the layers that are left, without gaps."""
    gone = events.groupBy("track_id", "kind").agg(F.max(F.when(F.col("seq") % 5 == 0, F.col("seq"))).alias("last"))
    born = events.join(gone, ["track_id", "kind"]).where("last is null or seq > last").groupBy("track_id", "kind").agg(F.min("seq").alias("since"))
    return born.select("track_id", F.col("kind").alias("layer"), "since", F.row_number().over(Window.partitionBy("track_id").orderBy("since")).alias("zorder"))


def _half_up(e: str) -> str:
    return f"printf('%.2f', floor(({e}) * 100 + 5e-1) / 1e2)"


@register("dtm_nodes", sql=f"SELECT row_, col, concat({_half_up('x')}, ';', {_half_up('y')}, ';', CASE WHEN col % 7 <> 0 THEN {_half_up('z')} ELSE '' END, ';', {_half_up('z + 1')}) AS line FROM dtm_nodes")
def profile_csv(nodes: DataFrame) -> DataFrame:
    """Lines of a profile's text: place and two heights, one of which may be missing."""
    z = F.when(F.col("col") % 7 != 0, F.col("z"))
    return nodes.select("row_", "col", images.csv_line(F.col("x"), F.col("y"), z, F.col("z") + 1).alias("line"))


@register("pt_features", sql="SELECT feature_id, class AS name, round(x + 1, 6) AS second, CAST(2 AS BIGINT) AS n, class || '-2' AS note FROM pt_features")
def xml_paths(features: DataFrame) -> DataFrame:
    """Values of a feature's XML by path and place: text, number, count, attribute."""
    point = lambda k: F.concat(F.lit('<point note="'), F.col("class"), F.lit(f'-{k + 1}"><x>'), (F.col("x") + k).cast("string"), F.lit("</x></point>"))
    xml = features.select("feature_id", F.concat(F.lit("<feature><name>"), F.col("class"), F.lit("</name><!-- two --><points>"), point(0), point(1), F.lit("</points></feature>")).alias("t"))
    at = lambda f, path: f("t", F.lit(path))
    return xml.select("feature_id", at(F.xpath_string, "/feature/name").alias("name"), at(F.xpath_double, "/feature/points/point[2]/x").alias("second"), F.size(at(F.xpath, "/feature/points/point/x/text()")).cast("long").alias("n"), at(F.xpath_string, "/feature/points/point[2]/@note").alias("note"))


@register("dtm_nodes", sql=f"""+ size AS (SELECT max(row_) h, max(col) w FROM dtm_nodes), head AS (SELECT unnest([['0', 'ncols ' || (w + 1)], ['1', 'nrows ' || (h + 1)], ['2', 'xllcenter 650000.000'], ['3', printf('yllcenter %.3f', 6861000 - h * 5e1)], ['4', 'cellsize 50.000'], ['5', 'nodata_value -9999']]) p FROM size),
    g AS (SELECT r AS row_, c AS col FROM (SELECT unnest(range(h + 1)) r, w FROM size), range(20) q(c) WHERE c <= w)
    SELECT CAST(p[1] AS BIGINT) AS line, p[2] AS value FROM head UNION ALL SELECT row_ + 6, string_agg(coalesce({_half_up('z')}, '-9999'), ' ' ORDER BY col) FROM g LEFT JOIN (SELECT * FROM dtm_nodes WHERE (row_ + col) % 11 <> 0) n USING (row_, col) GROUP BY 1""")  # fmt: skip
def asc_grid(nodes: DataFrame) -> DataFrame:
    """Lines of an ASC file of the grid with a node in eleven missing."""
    known = nodes.withColumn("z", F.when((F.col("row_") + F.col("col")) % 11 != 0, F.col("z")))
    return text.asc_lines(known, 650000.0, 6861000.0, 50.0)
