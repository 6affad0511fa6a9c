"""Queries of frames, polygons, rasters, tiles and catalogs with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from geoloom.functions import geometry as G
from geoloom.functions import grids
from geoloom.operators import nearest, order
from geoloom.plans.registry import inside, register, rint

FRAME = G.Frame(650200.0, 6860100.0, 650700.0, 6860600.0)


@register("pt_features", sql=f"SELECT feature_id FROM pt_features WHERE {inside(FRAME)}")
def select_frame(features):
    """All features in a frame, seen or not."""
    return features.where(G.in_frame(F.col("x"), F.col("y"), FRAME)).select("feature_id")


@register("pt_features", sql="SELECT feature_id, true AS visible FROM pt_features")
def show_all(features):
    return features.select("feature_id", F.lit(True).alias("visible"))


@register("pt_features", sql="SELECT class, arg_min(['vector', 'raster', 'dtm', 'las'][zorder % 4 + 1], feature_id) kind FROM pt_features GROUP BY 1")
def class_kinds(features):
    """A class is of the kind of its first feature."""
    kinds = F.array(*map(F.lit, ("vector", "raster", "dtm", "las")))
    return features.groupBy("class").agg(F.min_by(F.element_at(kinds, (F.col("zorder") % 4 + 1).cast("int")), "feature_id").alias("kind"))


@register("zones", sql="SELECT zone_id FROM zones WHERE zone_id % 6 <= 5 AND 5 < zone_id % 6 + 1 + layer")
def style_zoom(zones):
    """Style layers that are drawn at zoom 5: from their first zoom on, up to their last, which is left out."""
    low = F.col("zone_id") % 6
    return zones.where((low <= 5) & (F.lit(5) < low + 1 + F.col("layer"))).select("zone_id")


GROWN = 0.05 * max(FRAME.xmax - FRAME.xmin, FRAME.ymax - FRAME.ymin)
MARGIN = G.Frame(FRAME.xmin - GROWN, FRAME.ymin - GROWN, FRAME.xmax + GROWN, FRAME.ymax + GROWN)


@register("pt_features", sql=f"SELECT feature_id FROM pt_features WHERE {inside(MARGIN)}")
def points_margin(features):
    """Points that a frame shows, their symbols included: it grows by a twentieth of its longer side."""
    return features.where(G.in_frame(F.col("x"), F.col("y"), MARGIN)).select("feature_id")


EDGES = """+ ring AS (SELECT zone_id, (xmin+xmax)/2 cx, (ymin+ymax)/2 cy, xmin, ymin, xmax, ymax FROM zones), edge AS (
    SELECT zone_id, cx ax, ymax ay, xmax bx, cy "by" FROM ring UNION ALL SELECT zone_id, xmax, cy, cx, ymin FROM ring UNION ALL SELECT zone_id, cx, ymin, xmin, cy FROM ring UNION ALL SELECT zone_id, xmin, cy, cx, ymax FROM ring)"""
CROSSED = """sum(CASE WHEN (ax-ay <= x-y) <> (bx-"by" <= x-y) THEN CASE WHEN ax+ay + ((x-y)-(ax-ay))/((bx-"by")-(ax-ay))*((bx+"by")-(ax+ay)) > x+y THEN 1 ELSE 0 END ELSE 0 END) % 2 = 1"""


def diamonds(zones, k: float = 0.0):
    """zone_id, ring: the middles of a frame's sides, moved outwards by k sides."""
    cx, cy, w, h = (F.col("xmin") + F.col("xmax")) / 2, (F.col("ymin") + F.col("ymax")) / 2, F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin")
    ends = ((cx, F.col("ymax") + k * h), (F.col("xmax") + k * w, cy), (cx, F.col("ymin") - k * h), (F.col("xmin") - k * w, cy))
    return zones.select("zone_id", F.array(*(F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in (*ends, ends[0]))).alias("ring"))


@register("zones", "pt_features", sql=EDGES + f" SELECT zone_id, feature_id FROM pt_features JOIN zones ON x >= xmin AND x <= xmax AND y >= ymin AND y <= ymax JOIN edge USING (zone_id) GROUP BY zone_id, feature_id HAVING {CROSSED}")
def near_polygons(zones, features):
    """Features in polygons of a table: first in a polygon's frame, then inside its ring."""
    return nearest.in_polygons(features.select("feature_id", "x", "y"), diamonds(zones)).select("zone_id", "feature_id")


@register("zones", sql=EDGES + f""", tip AS (SELECT zone_id other, cx x, ymax + (ymax-ymin)*3e-1 y FROM ring UNION ALL SELECT zone_id, xmax + (xmax-xmin)*3e-1, cy FROM ring UNION ALL SELECT zone_id, cx, ymin - (ymax-ymin)*3e-1 FROM ring UNION ALL SELECT zone_id, xmin - (xmax-xmin)*3e-1, cy FROM ring)
    SELECT DISTINCT zone_id, other FROM (SELECT e.zone_id, t.other, t.x, t.y FROM edge e JOIN ring r USING (zone_id) JOIN tip t ON t.x >= r.xmin AND t.x <= r.xmax AND t.y >= r.ymin AND t.y <= r.ymax GROUP BY e.zone_id, t.other, t.x, t.y HAVING {CROSSED})""")  # fmt: skip
def polygon_overlap(zones):
    """Pairs of polygons of which the first holds a vertex of the other."""
    tips = diamonds(zones, 0.3).select(F.col("zone_id").alias("other"), F.explode("ring").alias("p")).select("other", "p.x", "p.y")
    return nearest.in_polygons(tips, diamonds(zones)).select("zone_id", "other").distinct()


@register("zones", "las_points", sql="""+ s AS (SELECT zone_id, (xmin+xmax)/2 sx, (ymin+ymax)/2 sy FROM zones),
    n AS (SELECT zone_id, z, row_number() OVER (PARTITION BY zone_id ORDER BY (x-sx)*(x-sx)+(y-sy)*(y-sy), l_orderkey, l_linenumber) k FROM s CROSS JOIN las_points) SELECT zone_id, round(z, 6) z FROM n WHERE k = 1""")  # fmt: skip
def profile_nearest(zones, points):
    """The height of the nearest point to each sample, however far."""
    samples = zones.select("zone_id", ((F.col("xmin") + F.col("xmax")) / 2).alias("x"), ((F.col("ymin") + F.col("ymax")) / 2).alias("y"))
    return nearest.nearest_of_all(samples, points, "zone_id", 5.0)


@register("dtm_nodes", sql="""+ stack AS (SELECT 0 dtm, row_, col, z FROM dtm_nodes WHERE (row_ + col) % 3 <> 0 UNION ALL SELECT 1, row_, col, z + 1000 FROM dtm_nodes WHERE (row_ + col) % 2 = 0),
    g AS (SELECT v * 30 + u AS feature_id, CAST(floor(u * 3e1 / 5e1 + 5e-1) AS BIGINT) col, CAST(floor(v * 3e1 / 5e1 + 5e-1) AS BIGINT) row_ FROM range(30) a(u), range(25) b(v))
    SELECT g.feature_id, round(arg_min(s.z, s.dtm), 6) z FROM g LEFT JOIN stack s ON g.row_ = s.row_ AND g.col = s.col GROUP BY 1""")  # fmt: skip
def z_grid(nodes):
    """Heights on a regular grid of 30 by 25 places, 30 m apart, from the first of two grids that has one."""
    first = nodes.where((F.col("row_") + F.col("col")) % 3 != 0).withColumn("dtm", F.lit(0))
    second = nodes.where((F.col("row_") + F.col("col")) % 2 == 0).withColumn("z", F.col("z") + 1000).withColumn("dtm", F.lit(1))
    u, v = F.col("id") % 30, F.floor(F.col("id") / 30)
    places = nodes.sparkSession.range(750).select(F.col("id").alias("feature_id"), (650000.0 + u * 30.0).alias("x"), (6861000.0 - v * 30.0).alias("y"))
    return nearest.first_height(places, first.unionByName(second), 650000.0, 6861000.0, 50.0)


@register("pt_features", sql="SELECT class, round(least(10, min(5e-1 + feature_id % 40)), 6) resolution FROM pt_features WHERE visible GROUP BY 1")
def min_resolution(features):
    """The finest resolution that a class shows, 10 at most."""
    return features.where("visible").groupBy("class").agg(F.least(F.lit(10.0), F.min(F.lit(0.5) + F.col("feature_id") % 40)).alias("resolution"))


@register("zones", "las_points", sql="""+ f AS (SELECT las_id, min(x) x0, max(x) x1, min(y) y0, max(y) y1, min(z) z0, max(z) z1 FROM las_points GROUP BY 1)
    SELECT zone_id, round(min(z0), 6) zmin, round(max(z1 - z0), 6) height FROM zones JOIN f ON x0 <= xmax AND x1 >= xmin AND y0 <= ymax AND y1 >= ymin GROUP BY 1""")  # fmt: skip
def las_zone(zones, points):
    """Lowest height and largest height difference of the clouds whose frames meet a zone."""
    side = lambda f, c: f(c).alias(f"{c}{f.__name__}")
    files = points.groupBy("las_id").agg(side(F.min, "x"), side(F.max, "x"), side(F.min, "y"), side(F.max, "y"), side(F.min, "z"), side(F.max, "z"))
    return nearest.meeting(zones, files).groupBy("zone_id").agg(F.min("zmin2").alias("zmin"), F.max(F.col("zmax2") - F.col("zmin2")).alias("height"))


@register("pt_features", sql="""+ q AS (SELECT feature_id, x - 650000 ax, y - 6860000 ay, z bx, 10e0 "by", y - 6860000 cx, x - 650000 cy FROM pt_features), d AS (SELECT *, sqrt((ax-bx)*(ax-bx)+(ay-"by")*(ay-"by")) da, sqrt((cx-bx)*(cx-bx)+(cy-"by")*(cy-"by")) dc FROM q),
    w AS (SELECT *, CASE WHEN da > 0 AND dc > 0 THEN (ax-bx)/da + (cx-bx)/dc END u, CASE WHEN da > 0 AND dc > 0 THEN (ay-"by")/da + (cy-"by")/dc END v FROM d)
    SELECT feature_id, round(CASE WHEN u*u+v*v > 0 THEN CASE WHEN v >= 0 THEN acos(greatest(-1, least(1, u/sqrt(u*u+v*v)))) ELSE 2*pi() - acos(greatest(-1, least(1, u/sqrt(u*u+v*v)))) END END, 6) bearing FROM w""")  # fmt: skip
def bisectors(features):
    x, y = F.col("x") - 650000, F.col("y") - 6860000
    return features.select("feature_id", grids.bisector(x, y, F.col("z"), F.lit(10.0), y, x).alias("bearing"))


@register("zones", sql=f"""SELECT zone_id, round(sqrt((xmin-{FRAME.xmin})*(xmin-{FRAME.xmin})+(ymin-{FRAME.ymin})*(ymin-{FRAME.ymin})) + sqrt((xmax-{FRAME.xmax})*(xmax-{FRAME.xmax})+(ymin-{FRAME.ymin})*(ymin-{FRAME.ymin}))
    + sqrt((xmax-{FRAME.xmax})*(xmax-{FRAME.xmax})+(ymax-{FRAME.ymax})*(ymax-{FRAME.ymax})) + sqrt((xmin-{FRAME.xmin})*(xmin-{FRAME.xmin})+(ymax-{FRAME.ymax})*(ymax-{FRAME.ymax})), 6) distance FROM zones""")  # fmt: skip
def frame_distance(zones):
    """Of two frames the sum of the distances between their corners."""
    far = [F.sqrt(G.dist2(F.col(x), F.col(y), getattr(FRAME, x), getattr(FRAME, y))) for x in ("xmin", "xmax") for y in ("ymin", "ymax")]
    return zones.select("zone_id", sum(far[1:], far[0]).alias("distance"))


@register("pt_features", sql="""+ w AS (SELECT feature_id, (feature_id % 100) / 1e2 o, (feature_id % 90) / 1e2 p, (feature_id % 300) / 1e2 k FROM pt_features)
    SELECT feature_id, round(sin(p), 6) + 0e0 opk_02, round(sin(o)*sin(k) - sin(p)*cos(o)*cos(k), 6) + 0e0 opk_20, round(sin(o)*sin(k) - sin(p)*cos(o)*cos(k), 6) + 0e0 kpo_back_02, round(-sin(k)*cos(p), 6) + 0e0 kpo_back_10,
    round(cos(p)*cos(k) + sin(p)*sin(o)*sin(k), 6) + 0e0 kop_back_00, round(-sin(o), 6) + 0e0 kop_back_21, round(sin(k)*sin(o) + cos(k)*sin(p)*cos(o), 6) + 0e0 kpo_02, round(-sin(p), 6) + 0e0 kpo_20 FROM w""")  # fmt: skip
def rotation_orders(features):
    """The four orders of three rotations."""
    angles = [(F.col("feature_id") % n) / 100.0 for n in (100, 90, 300)]
    made = {"opk": grids.turned("opk", *angles), "kpo_back": grids.turned("kpo", *angles, back=True), "kop_back": grids.turned("kop", *angles, back=True), "kpo": grids.turned("kpo", *angles)}
    wanted = {"opk": ((0, 2), (2, 0)), "kpo_back": ((0, 2), (1, 0)), "kop_back": ((0, 0), (2, 1)), "kpo": ((0, 2), (2, 0))}
    return features.select("feature_id", *((F.round(made[n][i][j], 6) + F.lit(0.0)).alias(f"{n}_{i}{j}") for n, places in wanted.items() for i, j in places))


@register("zones", sql="""+ f AS (SELECT zone_id, CAST(floor((1 + (xmin - 650000)*1e4/6378137e0/pi())/2*64) AS BIGINT) a, CAST(ceil((1 + (xmax - 650000)*1e4/6378137e0/pi())/2*64) AS BIGINT) b,
    CAST(floor((1 - (ymax - 6860000)*1e4/6378137e0/pi())/2*64) AS BIGINT) c, CAST(ceil((1 - (ymin - 6860000)*1e4/6378137e0/pi())/2*64) AS BIGINT) d FROM zones), g AS (SELECT zone_id, c, d, unnest(range(a, b)) tile_x FROM f) SELECT zone_id, tile_x, unnest(range(c, d)) tile_y FROM g""")  # fmt: skip
def tile_cover(zones):
    """Tiles of zoom 6 that cover each frame."""
    at = [(F.col(c) - o) * 1e4 for c, o in (("xmin", 650000), ("ymin", 6860000), ("xmax", 650000), ("ymax", 6860000))]
    a, b, c, d = grids.tile_range(*at, 6)
    across = zones.select("zone_id", F.explode(F.sequence(a, b - 1)).alias("tile_x"), c.alias("c"), d.alias("d"))
    return across.select("zone_id", "tile_x", F.explode(F.sequence("c", F.col("d") - 1)).alias("tile_y"))


SCALES = [559082264.0287178 / 2**i for i in range(19)]
KNOWN = "[" + ", ".join(repr(s * grids.PIXEL) + "::DOUBLE" for s in SCALES) + "]"


@register("pt_features", sql=f"""+ m AS (SELECT feature_id, 5e-1 + feature_id * 37e0 gsd, len(list_filter({KNOWN}, lambda s: s > 5e-1 + feature_id * 37e0)) i FROM pt_features)
    SELECT feature_id, CAST(CASE WHEN i = 19 THEN 18 WHEN i > 0 AND gsd > ({KNOWN}[i] + {KNOWN}[i + 1]) * 5e-1 THEN i - 1 ELSE i END AS INT) matrix FROM m""")  # fmt: skip
def wmts_matrix(features):
    return features.select("feature_id", grids.matrix(F.lit(0.5) + F.col("feature_id") * 37.0, SCALES).cast("int").alias("matrix"))


LON, LAT = "((feature_id * 37) % 3600) / 1e1 - 180", "((feature_id * 13) % 1600) / 1e1 - 80"


@register("pt_features", sql=f"""+ s AS (SELECT feature_id, {LON} lon, {LAT} lat, feature_id * 1e4 / 2468 s FROM pt_features)
    SELECT feature_id, printf('https://www.google.com/maps/@?api=1&map_action=map&center=%.6f,%.6f&zoom=%d&basemap=terrain', lat, lon, CAST(CASE WHEN s < 1 THEN 17 WHEN s >= 131072 THEN 0 ELSE least(17, 17 - floor(log2(s))) END AS BIGINT)) url FROM s""")  # fmt: skip
def map_url(features):
    """A link to a web map at a feature, with the zoom of a scale."""
    return features.select("feature_id", F.format_string("https://www.google.com/maps/@?api=1&map_action=map&center=%.6f,%.6f&zoom=%d&basemap=terrain", F.expr(LAT), F.expr(LON), grids.map_zoom(F.col("feature_id") * 1e4)).alias("url"))


@register("dtm_nodes", sql="+ e AS (SELECT min(z) lo, max(z) hi FROM dtm_nodes) SELECT i AS band, round(lo + (i - 1) * ((hi - lo) / 6), 6) z FROM e, range(1, 7) r(i)")
def altitude_ranges(nodes):
    """Equal altitude bands of a palette of seven colours; the first colour has no threshold."""
    ends = nodes.agg(F.min("z").alias("lo"), F.max("z").alias("hi"))  # one row
    return ends.select(F.explode(F.sequence(F.lit(1).cast("long"), F.lit(6).cast("long"))).alias("band"), "lo", "hi").select("band", (F.col("lo") + (F.col("band") - 1) * ((F.col("hi") - F.col("lo")) / 6)).alias("z"))


def _away(e: str) -> str:
    return f"CAST(sign({e}) * floor(abs({e}) + 5e-1) AS BIGINT)"


@register("zones", sql=f"""+ a AS (SELECT zone_id, xmin, ymin, xmax, ymax, greatest(0, {_away('(xmin - 650100) / 7e0')}) u, greatest(0, {_away('(6860900 - ymax) / 7e0')}) v, least(100, {_away('(xmax - 650100) / 7e0')}) u1, least(80, {_away('(6860900 - ymin) / 7e0')}) v1 FROM zones),
    b AS (SELECT *, {_away('(u * 7e0 + 650100 - xmin) / 3e0')} r, {_away('(ymax - (6860900 - v * 7e0)) / 3e0')} s, {_away('(u1 * 7e0 + 650100 - xmin) / 3e0')} r1, {_away('(ymax - (6860900 - v1 * 7e0)) / 3e0')} s1 FROM a)
    SELECT zone_id, u, v, u1 - u w, v1 - v h, r, s, r1 - r wr, s1 - s hs FROM b WHERE r1 > r AND s1 > s""")  # fmt: skip
def window_clip(zones):
    """Pixels of an image of 100 by 80 that each frame takes, and where they are drawn."""
    cut = grids.window(*(F.col(c) for c in ("xmin", "ymin", "xmax", "ymax")), (650100.0, 6860900.0), 7.0, (100, 80), 3.0)
    return zones.select("zone_id", *(c.cast("long").alias(n) for n, c in cut.items())).where("wr > 0 and hs > 0")


@register("pt_features", sql=f"+ p AS (SELECT feature_id, {rint(f'((x - {FRAME.xmin}) / 7e0)')} u, {rint(f'(({FRAME.ymax} - y) / 7e0)')} v FROM pt_features WHERE {inside(FRAME)}) SELECT feature_id, u, v, round({FRAME.xmin} + u * 7e0, 6) gx, round({FRAME.ymax} - v * 7e0, 6) gy FROM p")
def pixel_ground(features):
    u, v = grids.to_pixel(F.col("x"), F.col("y"), FRAME, 7.0)
    gx, gy = grids.to_ground(F.col("u"), F.col("v"), FRAME, 7.0)
    return features.select("feature_id", u.alias("u"), v.alias("v")).where("u is not null").select("feature_id", "u", "v", gx.alias("gx"), gy.alias("gy"))


@register("dtm_nodes", sql="SELECT a.row_, a.col, count(*) n, round(avg(b.z), 6) mean FROM dtm_nodes a JOIN dtm_nodes b ON b.row_ BETWEEN a.row_ - 1 AND a.row_ + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1 GROUP BY 1, 2")
def raw_window(nodes):
    """Count and mean of the three by three nodes around each: a node goes to its nine places, one shuffle."""
    step = F.array(*(F.lit(k) for k in (-1, 0, 1)))
    sent = nodes.withColumn("dr", F.explode(step)).withColumn("dc", F.explode(step))
    own = F.max((F.col("dr") == 0) & (F.col("dc") == 0))
    met = sent.groupBy((F.col("row_") + F.col("dr")).alias("row_"), (F.col("col") + F.col("dc")).alias("col")).agg(F.count("*").alias("n"), F.avg("z").alias("mean"), own.alias("own"))
    return met.where("own").drop("own")


@register("pixels", sql="""+ v AS (SELECT scene, pixel, CAST(b03 AS DOUBLE) p, CAST(b04 AS DOUBLE) a, CAST(b08 AS DOUBLE) b, CAST(b03 + b04 AS DOUBLE) c FROM pixels)
    SELECT scene, pixel, round(a, 6) near, round(a + (b - a)*3e-1, 6) lin, round((-p+3*a-3*b+c)/6*27e-3 + (3*(p-a)+3*(b-a))/6*9e-2 + (-2*(p-a)+6*(b-a)-(c-a))/6*3e-1 + a, 4) cubic,
    round((-p+a-b+c)*27e-3 + (2*(p-a)+b-c)*9e-2 + (b-p)*3e-1 + a, 4) conv, round((p + (a-p)*3e-1)*4e-1 + (b + (c-b)*3e-1)*6e-1, 4) bilin FROM v""")  # fmt: skip
def interpolators(pixels):
    """Values at 0.3 between the second and third of four by five kernels; two rows at 0.6."""
    p, a, b = (F.col(c).cast("double") for c in ("b03", "b04", "b08"))
    c = p + a
    return pixels.select("scene", "pixel", grids.nearest(a, b, 0.3).alias("near"), grids.linear(a, b, 0.3).alias("lin"), F.round(grids.lagrange(p, a, b, c, 0.3), 4).alias("cubic"), F.round(grids.convolution(p, a, b, c, 0.3), 4).alias("conv"), F.round(grids.twice(grids.linear, [[p, a], [b, c]], 0.3, 0.6), 4).alias("bilin"))


@register("pixels", sql="""+ v AS (SELECT scene, pixel, pixel % 7 / 7e0 AS t, CAST(b03 AS DOUBLE) p, CAST(b04 AS DOUBLE) a, CAST(b08 AS DOUBLE) b, CAST(b03 + b04 AS DOUBLE) c FROM pixels)
    SELECT scene, pixel, CASE WHEN t <= 5e-1 THEN a ELSE b END AS near, round(a + (b - a)*t, 4) AS lin, round((-p+3*a-3*b+c)/6*t*t*t + (3*(p-a)+3*(b-a))/6*t*t + (-2*(p-a)+6*(b-a)-(c-a))/6*t + a, 3) AS cubic,
    round((-p+a-b+c)*t*t*t + (2*(p-a)+b-c)*t*t + (b-p)*t + a, 3) AS conv FROM v""")  # fmt: skip
def interp_offsets(pixels):
    """The kernels at an offset of each row's own."""
    p, a, b = (F.col(c).cast("double") for c in ("b03", "b04", "b08"))
    c, t = p + a, F.col("pixel") % 7 / 7.0
    return pixels.select("scene", "pixel", grids.nearest(a, b, t).alias("near"), F.round(grids.linear(a, b, t), 4).alias("lin"), F.round(grids.lagrange(p, a, b, c, t), 3).alias("cubic"), F.round(grids.convolution(p, a, b, c, t), 3).alias("conv"))


BANDS = "(b03 * 3) % 9000 + 1000 b02, b03, b04, b08, (b08 * 7) % 9000 + 1000 b8a, (b04 * 5) % 9000 + 1000 b11, (b03 * 11) % 9000 + 1000 b12"


@register("pixels", sql=f"+ m AS (SELECT scene, pixel, {BANDS} FROM pixels) " + " UNION ALL ".join(f"SELECT scene, pixel, '{m}' AS mode, {r} r, {g} g, {b} b FROM m" for m, (r, g, b) in grids.COMPOSITES.items()))
def band_composites(pixels):
    modes = F.array(*(F.struct(F.lit(m).alias("mode"), F.col(r).alias("r"), F.col(g).alias("g"), F.col(b).alias("b")) for m, (r, g, b) in grids.COMPOSITES.items()))
    return pixels.selectExpr("scene", "pixel", *BANDS.split(", ")).select("scene", "pixel", F.explode(modes).alias("m")).select("scene", "pixel", "m.*")


NAME = "concat('T31TC', CASE WHEN scene % 2 = 0 THEN 'J' ELSE 'K' END, '_', CAST(20200100 + (scene * 7) % 29 AS STRING), 'T105421_', CASE scene % 4 WHEN 0 THEN 'B04' WHEN 1 THEN 'B8A' WHEN 2 THEN 'B99' ELSE 'B11' END, '_', CASE WHEN scene % 9 = 0 THEN '15m' ELSE '20m' END)"


@register("pixels", sql=f"""+ n AS (SELECT DISTINCT scene, {NAME} f FROM pixels), s AS (SELECT scene, f[:3] proj, f[4:6] tile, f[8:15] date, f[24:26] channel, f[28:30] resol FROM n WHERE scene % 4 <> 2 AND scene % 9 <> 0)
    SELECT *, row_number() OVER (PARTITION BY tile ORDER BY date, scene) pos FROM s""")  # fmt: skip
def scene_names(pixels):
    """Scenes by the parts of their file names, in the order of dates in each tile; names that are none are left out."""
    known = pixels.select("scene", F.expr(NAME).alias("name")).distinct().select("scene", grids.scene_name(F.col("name")).alias("n")).where("n is not null")
    return known.select("scene", "n.proj", "n.tile", "n.date", "n.channel", "n.resol").withColumn("pos", F.row_number().over(Window.partitionBy("tile").orderBy("date", "scene")))


@register("pixels", sql="""+ i AS (SELECT scene, pixel, CASE WHEN abs(b08+b04-2000) < 1e-6 THEN -1 ELSE (b08-b04)/CAST(b08+b04-2000 AS DOUBLE) END v, CASE WHEN abs(b03+b08-2000) < 1e-6 THEN -1 ELSE (b03-b08)/CAST(b03+b08-2000 AS DOUBLE) END w FROM pixels)
    SELECT scene, pixel, CAST(CASE WHEN v > 6e-1 THEN trunc(127 + v*127) ELSE 0 END AS INT) green, CAST(CASE WHEN w > 0 THEN trunc(127 + w*127) ELSE 0 END AS INT) blue FROM i""")  # fmt: skip
def index_render(pixels):
    """Vegetation over 0.6 and water over 0 as ramps of a channel."""
    shown = lambda c, cut: F.when(c > cut, (127 + c * 127).cast("int")).otherwise(0)
    ndvi, ndwi = G.normalised_difference(F.col("b08"), F.col("b04")), G.normalised_difference(F.col("b03"), F.col("b08"))
    return pixels.select("scene", "pixel", shown(ndvi, 0.6).alias("green"), shown(ndwi, 0.0).alias("blue"))


@register("las_points", sql="SELECT las_id, l_orderkey, l_linenumber FROM las_points WHERE 100 / pow(2, classification) >= 8")
def detail_limit(points):
    """Points of the octree levels that are at least 8 m apart, where level 0 is 100 m apart: reading stops before the first finer level."""
    stop = next(k for k in range(64) if 100.0 / 2**k < 8.0)
    return points.where(F.col("classification") < stop).select("las_id", "l_orderkey", "l_linenumber")


@register("las_points", sql="SELECT las_id, l_orderkey, l_linenumber FROM las_points ORDER BY las_id, l_orderkey, l_linenumber, x, y, z LIMIT 1000")
def point_budget(points):
    """The first 1,000 points in the order of files: the budget is the feature."""
    return points.orderBy("las_id", "l_orderkey", "l_linenumber", "x", "y", "z").select("las_id", "l_orderkey", "l_linenumber").limit(1000)


@register("las_points", sql="SELECT las_id, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY las_id ORDER BY classification, x, y, z, l_orderkey, l_linenumber) pos FROM las_points")
def entry_order(points):
    """Entries of a file by level, then place; no file's entries meet in one task."""
    by = [F.col(c) for c in ("classification", "x", "y", "z", "l_orderkey", "l_linenumber")]
    return order.numbered_in(points, "las_id", by).select("las_id", "l_orderkey", "l_linenumber", "pos")


@register("pt_features", sql="SELECT zorder, round(min(x), 6) xmin, round(min(y), 6) ymin, round(max(x), 6) xmax, round(max(y), 6) ymax, count(*) n FROM pt_features WHERE class <> 'BUILDING' GROUP BY 1")
def drop_class(features):
    """Frames of the layers that still have features once a class is gone."""
    ends = [f(c).alias(f"{c}{f.__name__}") for f in (F.min, F.max) for c in "xy"]
    return features.where("class <> 'BUILDING'").groupBy("zorder").agg(*ends, F.count("*").alias("n"))


@register("zones", sql="SELECT zone_id, row_number() OVER (ORDER BY name DESC) by_name, row_number() OVER (ORDER BY layer DESC, zone_id) by_layer FROM zones")
def list_orders(zones):
    """Places of a catalog's rows in two descending orders; a catalog is a few rows, so one window holds it."""
    return zones.select("zone_id", F.row_number().over(Window.orderBy(F.desc("name"))).alias("by_name"), F.row_number().over(Window.orderBy(F.desc("layer"), "zone_id")).alias("by_layer"))


@register("pt_features", sql="SELECT feature_id, abs(x - 650000 - (y - 6860000)) <= 5 AND abs(y - 6860000 - (x - 650000)) <= 5 AS same, abs(x - 650000) <= 1 AND abs(y - 6860000) <= 1 AS none, round(sqrt((x-650000)*(x-650000)+(y-6860000)*(y-6860000)), 6) norm FROM pt_features")
def point_tests(features):
    """Equal and zero within a tolerance on each axis, and length."""
    x, y = F.col("x") - 650000, F.col("y") - 6860000
    near = lambda a, b, e: F.abs(a - b) <= e
    return features.select("feature_id", (near(x, y, 5) & near(y, x, 5)).alias("same"), (near(x, 0, 1) & near(y, 0, 1)).alias("none"), F.sqrt(x * x + y * y).alias("norm"))
