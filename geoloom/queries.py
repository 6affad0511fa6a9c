"""The registered queries of the geospatial operators and the same results as SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.functions import geometry as G
from geoloom.operators import nearest, pointcloud, raster, selection, terrain
from geoloom.plans.registry import ORACLE, QUERIES, inside, r6, register, rint

FRAME = G.Frame(650200.0, 6860100.0, 650700.0, 6860600.0)
RING = [(650100.0, 6860100.0), (650300.0, 6860900.0), (650900.0, 6860700.0), (650600.0, 6860050.0), (650100.0, 6860100.0)]
STYLE = ["all", ["in", "kind", "click", "view"], ["!=", "k", "7"], ["==", "missing", "x"]]
GSD = 50.0

CELLS = f"""
    + ext AS (SELECT floor(min(x)/5e1)*5e1 x0, ceil(max(y)/5e1)*5e1 y1, ceil(max(x)/5e1)*5e1 x1, floor(min(y)/5e1)*5e1 y0 FROM las_points WHERE classification IN (1,2,3)),
    cells AS (SELECT * FROM (SELECT p.*, {rint("((x - x0) / 5e1)")} u, {rint("((y1 - y) / 5e1)")} v, x0, y0, x1, y1 FROM las_points p, ext WHERE classification IN (1,2,3)) WHERE u < (x1 - x0) / 5e1 AND v < (y1 - y0) / 5e1)"""


@register("las_points", sql=CELLS + """
    SELECT las_id, u, v, count(*) density, round(min(z),6) zmin, round(avg(z)+1e-9,6) zavg, round(max(z),6) zmax, round(coalesce(stddev_samp(z),0),6) zstd, round(max(z)-min(z),6) height FROM cells GROUP BY ALL""")  # fmt: skip
def las_grid(points):
    return pointcloud.grid(points.where(F.col("classification").isin(1, 2, 3)), GSD, ["las_id"]).withColumn("zavg", F.col("zavg") + 1e-9)  # means that end in a half at the seventh place round up on both sides


def _levels(n: int) -> str:
    out = []
    for k in range(1, n + 1):
        out.append(f", l{k} AS (SELECT u//2 u, v//2 v, avg(z) z FROM {'known' if k == 1 else f'l{k - 1}'} GROUP BY ALL)")
    return "".join(out)


@register("las_points", sql=CELLS + ", known AS (SELECT u, v, avg(z) z FROM cells GROUP BY ALL), size AS (SELECT max(u) mu, max(v) mv FROM known)" + _levels(5) + """,
    every AS (SELECT u, v FROM (SELECT unnest(range(0, mu + 1)) u, mv FROM size), LATERAL (SELECT unnest(range(0, mv + 1)) v))
    SELECT e.u, e.v, round(coalesce(k.z, l1.z, l2.z, l3.z, l4.z, l5.z) + 1e-9, 6) z FROM every e LEFT JOIN known k ON e.u=k.u AND e.v=k.v LEFT JOIN l1 ON e.u//2=l1.u AND e.v//2=l1.v LEFT JOIN l2 ON e.u//4=l2.u AND e.v//4=l2.v LEFT JOIN l3 ON e.u//8=l3.u AND e.v//8=l3.v
    LEFT JOIN l4 ON e.u//16=l4.u AND e.v//16=l4.v LEFT JOIN l5 ON e.u//32=l5.u AND e.v//32=l5.v""")  # fmt: skip
def las_fill_hole(points):
    """The rectangle of the cells that have points of the classes, all levels."""
    at = pointcloud.cells(points.where(F.col("classification").isin(1, 2, 3)), GSD)
    return pointcloud.fill_holes(at.groupBy("u", "v").agg(F.avg("z").alias("z"))).withColumn("z", F.col("z") + 1e-9)  # as in las_grid


@register("las_points", sql=CELLS + ", known AS (SELECT u, v, avg(z) z FROM cells GROUP BY ALL), size AS (SELECT CAST(round((x1-x0)/5e1) AS BIGINT) - 1 mu, CAST(round((y1-y0)/5e1) AS BIGINT) - 1 mv FROM ext)" + _levels(5) + """,
    every AS (SELECT u, v FROM (SELECT unnest(range(0, mu + 1)) u, mv FROM size), LATERAL (SELECT unnest(range(0, mv + 1)) v))
    SELECT e.u, e.v, round(coalesce(k.z, l1.z, l2.z, l3.z, l4.z, l5.z) + 1e-9, 6) z FROM every e LEFT JOIN known k ON e.u=k.u AND e.v=k.v LEFT JOIN l1 ON e.u//2=l1.u AND e.v//2=l1.v LEFT JOIN l2 ON e.u//4=l2.u AND e.v//4=l2.v LEFT JOIN l3 ON e.u//8=l3.u AND e.v//8=l3.v
    LEFT JOIN l4 ON e.u//16=l4.u AND e.v//16=l4.v LEFT JOIN l5 ON e.u//32=l5.u AND e.v//32=l5.v""")  # fmt: skip
def las_fill_hole_all(points):
    """The whole grid of the classes: its own extent, all levels, holes as they occur. A side of the view has at most 20 cells, so five levels in SQL."""
    some = points.where(F.col("classification").isin(1, 2, 3))
    known = pointcloud.cells(some, GSD).groupBy("u", "v").agg(F.avg("z").alias("z"))
    return pointcloud.fill_holes(known, size=pointcloud.raster(some, GSD)).withColumn("z", F.col("z") + 1e-9)  # as in las_grid


@register("las_points", sql="SELECT classification, count(*) n, round(min(x),6) xmin, round(max(x),6) xmax, round(min(y),6) ymin, round(max(y),6) ymax, round(min(z),6) zmin, round(max(z),6) zmax FROM las_points GROUP BY 1")
def las_stats(points):
    return pointcloud.statistics(points)


@register("las_points", sql="SELECT las_id, " + ", ".join(f"count(*) FILTER (classification = {k}) class_{k}" for k in pointcloud.ROLLUP_CLASSES) + f", count(*) FILTER (classification NOT IN {pointcloud.ROLLUP_CLASSES}) other FROM las_points GROUP BY 1")
def las_class_rollup(points):
    return pointcloud.class_rollup(points)


@register("las_points", sql=f"SELECT las_id, l_orderkey, l_linenumber, {r6('x y z')}, classification, intensity FROM las_points WHERE x > {FRAME.xmin} AND x < {FRAME.xmax} AND y > {FRAME.ymin} AND y < {FRAME.ymax} AND z BETWEEN 10 AND 60 AND classification IN (1,2,4)")
def las_clip(points):
    return pointcloud.clip(points, FRAME, 10, 60, [1, 2, 4])


@register("pt_features", sql=f"SELECT feature_id, class, zorder, {r6('x y z')} FROM pt_features WHERE visible AND selectable AND {inside(FRAME)}")
def select_features(features):
    return selection.select_features(features, FRAME).drop("visible", "selectable")


@register("pt_features", sql="SELECT feature_id FROM pt_features WHERE (x-650400)*(x-650400)+(y-6860400)*(y-6860400) < 22500")
def find_near(features):
    return selection.find_near(features, 650400.0, 6860400.0, 150.0).select("feature_id")


@register("pt_features", sql="SELECT feature_id, round((x-650400)*(x-650400)+(y-6860400)*(y-6860400), 6) d2 FROM pt_features ORDER BY (x-650400)*(x-650400)+(y-6860400)*(y-6860400), feature_id LIMIT 1")
def find_closest(features):
    return selection.find_closest(features, 650400.0, 6860400.0).select("feature_id", "d2")


@register("pt_features", sql=f"SELECT feature_id FROM pt_features WHERE selectable AND visible AND {inside(FRAME)} AND {inside(G.Frame(650300.0, 6860200.0, 650400.0, 6860300.0))}")
def keep_centroid(features):
    return selection.keep_centroid(selection.select_features(features, FRAME), G.Frame(650300.0, 6860200.0, 650400.0, 6860300.0)).select("feature_id")


@register("pt_features", sql=f"SELECT feature_id, visible AND {inside(FRAME)} AS visible FROM pt_features")
def hide_out_frame(features):
    return selection.hide_out_frame(features, FRAME).select("feature_id", "visible")


def _crossings() -> str:
    out = []
    for (ax, ay), (bx, by) in zip(RING, RING[1:], strict=False):
        au, bu = ax - ay, bx - by
        out.append(f"CASE WHEN (({au} <= x - y) <> ({bu} <= x - y)) AND {ax + ay} + (x - y - ({au})) / ({bu - au}) * ({bx + by - ax - ay}) > x + y THEN 1 ELSE 0 END")
    return " + ".join(out)


@register("pt_features", sql=f"SELECT feature_id, visible AND ({_crossings()}) % 2 = 1 AS visible FROM pt_features")
def hide_out_ring(features):
    return selection.hide_out_ring(features, RING).select("feature_id", "visible")


@register("pt_features", sql=f"SELECT class, {', '.join(f'round({f}({c}),6) {c}{f}' for c in 'xyz' for f in ('min', 'max'))}, count(*) n FROM pt_features GROUP BY ROLLUP(class)")
def class_frames(features):
    return selection.class_summary(features)


@register("pt_features", sql="SELECT class, zorder, round(mean,6) mean, row_number() OVER (ORDER BY zorder, mean, class) pos FROM (SELECT class, min(zorder) zorder, avg(zorder) mean FROM pt_features GROUP BY 1)")
def sort_class(features):
    return selection.class_order(features)


@register("pt_features", sql=f"SELECT zorder, feature_id FROM pt_features WHERE visible AND {inside(FRAME)} ORDER BY zorder DESC, feature_id DESC LIMIT 1")
def top_feature(features):
    return selection.top_feature(features, FRAME)


@register("pt_features", "las_points", sql="""SELECT feature_id, class, round(z - pz, 6) delta FROM (
    SELECT f.feature_id, f.class, f.z, p.z pz, row_number() OVER (PARTITION BY f.feature_id ORDER BY (f.x-p.x)*(f.x-p.x)+(f.y-p.y)*(f.y-p.y)+(f.z-p.z)*(f.z-p.z), p.l_orderkey DESC, p.l_linenumber DESC) k
    FROM pt_features f JOIN las_points p ON p.x BETWEEN f.x - 10 AND f.x + 10 AND p.y BETWEEN f.y - 10 AND f.y + 10 WHERE (f.x-p.x)*(f.x-p.x)+(f.y-p.y)*(f.y-p.y)+(f.z-p.z)*(f.z-p.z) <= 100) WHERE k = 1""")  # fmt: skip
def delta_las_vector(features, points):
    return nearest.delta_to_points(features, points, 10.0)


@register("pt_features", "las_points", sql="""SELECT feature_id, round(pz, 6) z FROM (
    SELECT f.feature_id, p.z pz, row_number() OVER (PARTITION BY f.feature_id ORDER BY (f.x-p.x)*(f.x-p.x)+(f.y-p.y)*(f.y-p.y), p.l_orderkey, p.l_linenumber) k
    FROM pt_features f JOIN las_points p ON abs(p.x - f.x) <= 2 AND abs(p.y - f.y) <= 2) WHERE k = 1""")  # fmt: skip
def nearest_z(features, points):
    return nearest.nearest_height(features, points, 2.0)


@register("zones", "las_points", sql="SELECT zone_id, count(*) n, round(min(z),6) zmin, round(max(z),6) zmax, round(avg(z),6) zmean FROM las_points JOIN zones ON x >= xmin AND x <= xmax AND y >= ymin AND y <= ymax GROUP BY 1")
def zonal_stats(zones, points):
    return nearest.zonal(zones, points)


NEAR = """+ near AS (SELECT *, coalesce(lead(z) OVER a, lag(z) OVER a, z) east, coalesce(lag(z) OVER d, lead(z) OVER d, z) north FROM dtm_nodes WINDOW a AS (PARTITION BY row_ ORDER BY col), d AS (PARTITION BY col ORDER BY row_)) """


@register("dtm_nodes", sql=NEAR + f"""SELECT row_, col, round(greatest(0, ((east-z)/5e1*{math.cos(math.radians(45)) * math.sin(math.radians(135))!r} + (north-z)/5e1*({math.cos(math.radians(45)) * math.cos(math.radians(135))!r}) + {math.sin(math.radians(45))!r}) / sqrt(((east-z)/5e1)*((east-z)/5e1) + ((north-z)/5e1)*((north-z)/5e1) + 1)), 6) shade,
    round(5e1 / sqrt((east-z)*(east-z) + (north-z)*(north-z) + 2500), 6) slope, CASE WHEN ceil(z/2e0) <> ceil(north/2e0) OR ceil(z/2e0) <> ceil(east/2e0) THEN CAST(round(z/2e0) AS BIGINT) ELSE -9999 END contour FROM near""")  # fmt: skip
def terrain_shade(nodes):
    c, n, e = F.col("z"), F.col("north"), F.col("east")
    return terrain.with_neighbours(nodes).select("row_", "col", G.hillshade(c, n, e, GSD).alias("shade"), G.slope_cosine(c, n, e, GSD).alias("slope"), F.coalesce(G.contour_level(c, n, e, 2.0), F.lit(-9999)).alias("contour"))


@register("dtm_nodes", sql="+ s AS (SELECT row_, col, greatest(abs(lead(z) OVER (PARTITION BY row_ ORDER BY col) - z), abs(lead(z) OVER (PARTITION BY col ORDER BY row_) - z)) step FROM dtm_nodes) SELECT row_, col, round(step, 6) step FROM s WHERE step > 2")
def delta_nodes(nodes):
    return terrain.large_steps(nodes, 2.0).select("row_", "col", "step")


@register("dtm_nodes", sql="SELECT round(sum(greatest(z - 1e2, 0)) * 2500, 6) volume, count(*) FILTER (z > 100) nodes FROM dtm_nodes")
def volume(nodes):
    return terrain.volume(nodes, 100.0, GSD)


@register("dtm_nodes", sql="""+ c AS (SELECT a.row_, a.col, a.z, e.z ze, s.z zs, d.z zse FROM dtm_nodes a JOIN dtm_nodes e ON e.row_=a.row_ AND e.col=a.col+1 JOIN dtm_nodes s ON s.row_=a.row_+1 AND s.col=a.col JOIN dtm_nodes d ON d.row_=a.row_+1 AND d.col=a.col+1)
    SELECT row_, col, 0 part, round(z,6) z, round(zs,6) z2, round(ze,6) z3 FROM c UNION ALL SELECT row_, col, 1, round(ze,6), round(zs,6), round(zse,6) FROM c""")  # fmt: skip
def stl_triangles(nodes):
    return terrain.triangles(nodes)


@register("tracks", sql="""+ legs AS (SELECT track_id, seq, coalesce(sqrt((x-lag(x) OVER w)*(x-lag(x) OVER w)+(y-lag(y) OVER w)*(y-lag(y) OVER w)),0) d, coalesce(z-lag(z) OVER w,0) dz FROM tracks WINDOW w AS (PARTITION BY track_id ORDER BY seq))
    SELECT track_id, seq, round(sum(d) OVER u, 6) length, round(sum(greatest(dz,0)) OVER u, 6) up, round(sum(least(dz,0)) OVER u, 6) down FROM legs WINDOW u AS (PARTITION BY track_id ORDER BY seq ROWS UNBOUNDED PRECEDING)""")  # fmt: skip
def profile_climb(tracks):
    return terrain.climb(tracks)


@register("las_points", sql="""+ p AS (SELECT x - 650000 x, y - 6860000 y, (x - 650000)*2e0 - (y - 6860000)*5e-1 + z x2, (x - 650000)*25e-2 + (y - 6860000)*3e0 - z y2 FROM las_points),
    s AS (SELECT var_pop(x) vx, var_pop(y) vy, covar_pop(x,y) vxy, covar_pop(x,x2) xx2, covar_pop(x,y2) xy2, covar_pop(y,x2) yx2, covar_pop(y,y2) yy2, avg(x) mx, avg(y) my, avg(x2) mx2, avg(y2) my2 FROM p),
    t AS (SELECT (xx2*vy-yx2*vxy)/(vx*vy-vxy*vxy) a, (yx2*vx-xx2*vxy)/(vx*vy-vxy*vxy) b, (xy2*vy-yy2*vxy)/(vx*vy-vxy*vxy) d, (yy2*vx-xy2*vxy)/(vx*vy-vxy*vxy) e, * FROM s)
    SELECT round(a,6) a, round(b,6) b, round(mx2-a*mx-b*my,6) c, round(d,6) d, round(e,6) e, round(my2-d*mx-e*my,6) f FROM t""")  # fmt: skip
def affinity_fit(points):
    x, y = F.col("x") - 650000, F.col("y") - 6860000
    return terrain.affinity(points.select(x.alias("x"), y.alias("y"), (x * 2.0 - y * 0.5 + F.col("z")).alias("x2"), (x * 0.25 + y * 3.0 - F.col("z")).alias("y2")))


INDEX = "CASE WHEN abs({a}+{b}-2000) < 1e-6 THEN -1 ELSE ({a}-{b})/CAST({a}+{b}-2000 AS DOUBLE) END"


@register("pixels", sql=f"SELECT scene, pixel, round({INDEX.format(a='b08', b='b04')}, 6) ndvi, round({INDEX.format(a='b03', b='b08')}, 6) ndwi FROM pixels")
def spectral_indices(pixels):
    return pixels.select("scene", "pixel", G.normalised_difference(F.col("b08"), F.col("b04")).alias("ndvi"), G.normalised_difference(F.col("b03"), F.col("b08")).alias("ndwi"))


@register("pixels", sql="+ h AS (SELECT b04 // 40 AS level, count(*) n FROM pixels GROUP BY 1), g AS (SELECT level, level - lag(level) OVER (ORDER BY level) - 1 gap FROM h) SELECT min(level) AS first, max(level) AS last, count(*) used, coalesce(max(gap), 0) longest_gap FROM g")
def histogram_analyze(pixels):
    return raster.analyse(raster.histogram(pixels, F.floor(F.col("b04") / 40)))


@register("pixels", sql="+ h AS (SELECT b04 // 40 AS level, count(*) n FROM pixels GROUP BY 1), g AS (SELECT level, sum(n) OVER (ORDER BY level) run, sum(n) OVER () total FROM h) SELECT min(level) FILTER (run > 1e-3 * total) low, min(level) FILTER (run >= (1 - 1e-3) * total) high FROM g")
def contrast_limits(pixels):
    return raster.contrast(raster.histogram(pixels, F.floor(F.col("b04") / 40)))


@register("pixels", sql="SELECT scene, pixel, CASE WHEN b04 < 2000 THEN 0 WHEN b04 >= 8000 THEN 255 ELSE CAST(trunc(pow((b04 - 2000) / 6e3, 5e-1) * 255) AS INT) END shown FROM pixels")
def lut_gamma(pixels):
    return pixels.select("scene", "pixel", G.channel(F.col("b04"), 2000.0, 8000.0, 0.5).cast("int").alias("shown"))


@register("pixels", sql="SELECT scene, pixel, round(b03 + 15e-2*(b08-b04 + 3e-1*(2*b04-5*b03+4*b08-b04 + 3e-1*(3*(b03-b08)+b04-b04))), 6) z FROM pixels")
def interp_catmull(pixels):
    return pixels.select("scene", "pixel", G.catmull_rom(F.col("b04"), F.col("b03"), F.col("b08"), F.col("b04"), 0.3).cast("double").alias("z"))


@register("pixels", sql="SELECT scene, pixel, round((b03%256)*256 + b04%256 + (b08%256)/256e0 - 32768, 6) terrarium, round(((b03%256)*65536 + (b04%256)*256 + b08%256)*1e-1 - 10000, 6) rgb FROM pixels")
def elevation_tiles(pixels):
    r, g, b = (F.col(c) % 256 for c in ("b03", "b04", "b08"))
    return pixels.select("scene", "pixel", G.terrarium(r, g, b).cast("double").alias("terrarium"), G.terrain_rgb(r, g, b).cast("double").alias("rgb"))


LON, LAT = "((feature_id * 37) % 3600) / 1e1 - 180", "((feature_id * 13) % 1600) / 1e1 - 80"


@register("pt_features", sql=f"+ m AS (SELECT feature_id, radians({LON})*6378137e0 mx, ln(tan(radians({LAT})/2 + pi()/4))*6378137e0 my FROM pt_features) SELECT feature_id, round(mx, 3) mx, round(my, 3) + 0e0 my, round(degrees(mx/6378137e0), 6) lon, round(degrees(2*atan(exp(my/6378137e0)) - pi()/2), 6) + 0e0 lat, CAST(floor((1+mx/(pi()*6378137e0))/2*4096) AS BIGINT) tile_x, CAST(floor((1-my/(pi()*6378137e0))/2*4096) AS BIGINT) tile_y FROM m")
def mercator_tiles(features):
    mx, my = G.mercator(F.expr(LON), F.expr(LAT))
    m = features.select("feature_id", mx.alias("mx"), my.alias("my"))
    (lon, lat), (tx, ty) = G.mercator_inverse(F.col("mx"), F.col("my")), G.tile(F.col("mx"), F.col("my"), 12)
    return m.select("feature_id", F.round("mx", 3).alias("mx"), F.round("my", 3).alias("my"), lon.alias("lon"), lat.alias("lat"), tx.alias("tile_x"), ty.alias("tile_y"))


def style_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.where(raster.style_filter(STYLE, {"kind": F.col("event_type"), "k": F.get_json_object("props", "$.k")})).select("event_id")


QUERIES["style_filter"] = style_filter
ORACLE["style_filter"] = "SELECT event_id FROM events WHERE event_type IN ('click', 'view') AND coalesce(json_extract_string(props, '$.k') <> '7', true)"

from geoloom.plans import file_queries, image_queries, line_queries, map_queries, outline_queries, raster_queries, relief_queries, scalar_queries  # noqa: E402, F401 - they register their queries
