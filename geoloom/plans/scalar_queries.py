"""Queries of scalar functions, display rules, catalog operations and projections."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from geoloom.functions import projections as P
from geoloom.functions import scalars as C
from geoloom.functions.geometry import RADIUS
from geoloom.operators import catalog, selection, terrain
from geoloom.plans.registry import register

LOCAL = "+ q AS (SELECT feature_id, class, zorder, x - 650000 AS x, y - 6860000 AS y, z FROM pt_features) "


def local(features):
    return features.withColumn("x", F.col("x") - 650000).withColumn("y", F.col("y") - 6860000)


@register("pt_features", sql=LOCAL + """SELECT feature_id, round(x*y+y*x+z*1e1,6) dot, round(y*1e1-z*x,6) cx, round(z*y-x*1e1,6) cy, round(x*x-y*y,6) cz,
    round(abs((y-x)*(2e0-y)-(x-y)*(z-x))/2,6) area, CASE WHEN x <> y THEN round(abs((y-x)*(2e0-y)-(x-y)*(z-x))/sqrt((y-x)*(y-x)+(x-y)*(x-y)),6) END dist,
    CASE WHEN x <> y THEN round(((z-x)*(y-x)+(2e0-y)*(x-y))/((y-x)*(y-x)+(x-y)*(x-y)),6) END foot FROM q""")  # fmt: skip
def vector_math(features):
    x, y, z, two = F.col("x"), F.col("y"), F.col("z"), F.lit(2.0)
    a, b = (x, y, z), (y, x, F.lit(10.0))
    c = C.cross3(a, b)
    plane = (x, y, y, x, z, two)
    return local(features).select("feature_id", C.dot(a, b).alias("dot"), c[0].alias("cx"), c[1].alias("cy"), c[2].alias("cz"), C.triangle_area(*plane).alias("area"), C.line_distance(*plane).alias("dist"), C.foot(*plane).alias("foot"))


ANGLES = "+ w AS (SELECT feature_id, (feature_id % 100) / 1e2 o, (feature_id % 90) / 1e2 p, (feature_id % 300) / 1e2 k FROM pt_features) "


@register("pt_features", sql=ANGLES + """SELECT feature_id, round(cos(p)*cos(k),6) m00, round(-cos(p)*sin(k),6)+0e0 m01, round(cos(o)*sin(k)+sin(o)*sin(p)*cos(k),6) m10, round(cos(o)*cos(p),6) m22,
    round(o,6) omega, round(p,6) phi, round(k,6) kappa, round(CASE WHEN 90-degrees(k) < 0 THEN 450-degrees(k) ELSE 90-degrees(k) END,6) heading FROM w""")  # fmt: skip
def rotations(features):
    o, p, k = (((F.col("feature_id") % n) / 100.0) for n in (100, 90, 300))
    r = C.rotation(o, p, k)
    omega, phi, kappa = C.angles(r)
    return features.select("feature_id", r[0][0].alias("m00"), r[0][1].alias("m01"), r[1][0].alias("m10"), r[2][2].alias("m22"), omega.alias("omega"), phi.alias("phi"), kappa.alias("kappa"), C.heading(k).alias("heading"))


@register("pt_features", sql=LOCAL + "SELECT feature_id, round(x,4) gx, round(y,4) gy, round(z,4) gz, round(x,4) px, round(y,4) py, round(152e-3*(x-200)/(2000-z)*1e3,6) iu, round(152e-3*(y-300)/(2000-z)*1e3,6) iv FROM q")
def stereo_points(features):
    """Rays from two stations through each feature meet at it; its place in the first photograph."""
    at = tuple(F.col(c) for c in "xyz")
    left, right = tuple(map(F.lit, (200.0, 300.0, 2000.0))), tuple(map(F.lit, (900.0, 250.0, 2100.0)))
    ray = lambda s: tuple(p - q for p, q in zip(at, s, strict=True))
    got = C.meet(left, ray(left), right, ray(right))
    flat = C.on_plane(left, ray(left), F.col("z"))
    down = C.rotation(F.lit(0.0), F.lit(0.0), F.lit(0.0))
    u, v = C.project(at, left, down, 0.152)
    return local(features).select("feature_id", *(F.round(c, 4).alias(n) for n, c in zip(("gx", "gy", "gz", "px", "py"), (*got, *flat), strict=True)), (u * 1000).alias("iu"), (v * 1000).alias("iv"))


@register("pt_features", sql=LOCAL + "SELECT feature_id, round(x*2e0 - y*5e-1 + 10, 6) u, round(x*25e-2 + y*3e0 - 20, 6) v, round(x,6) back_x, round(y,6) back_y FROM q")
def affine_apply(features):
    k = (2.0, -0.5, 10.0, 0.25, 3.0, -20.0)
    moved = local(features).withColumns(dict(zip("uv", C.affine(F.col("x"), F.col("y"), k), strict=True)))
    bx, by = C.affine_inverse(F.col("u"), F.col("v"), k)
    return moved.select("feature_id", "u", "v", bx.alias("back_x"), by.alias("back_y"))


@register("las_points", sql="""+ p AS (SELECT x - 650000 x, y - 6860000 y, z FROM las_points) SELECT 2e0 a, -5e-1 b, 10e0 c, 25e-2 d, 3e0 e, -20e0 f, count(*) n, 0e0 rms FROM p""")
def robust_fit(points):
    """An exact relation but for points that were moved: the fit leaves them out."""
    x, y = F.col("x") - 650000, F.col("y") - 6860000
    k = (2.0, -0.5, 10.0, 0.25, 3.0, -20.0)
    u, v = C.affine(x, y, k)
    good = points.select(x.alias("x"), y.alias("y"), u.alias("x2"), v.alias("y2"))
    bad = good.agg(F.avg("x").alias("x"), F.avg("y").alias("y")).select("x", "y", F.lit(1e6).alias("x2"), F.lit(-1e6).alias("y2"))
    return catalog.robust_affinity(good.unionByName(bad)).select(*(F.round(c, 4).alias(c) if t == "double" else c for c, t in (("a", "double"), ("b", "double"), ("c", "double"), ("d", "double"), ("e", "double"), ("f", "double"), ("n", "long"), ("rms", "double")))).replace(-0.0, 0.0)


@register("las_points", sql="""+ p AS (SELECT x - 650000 x, y - 6860000 y, z FROM las_points) SELECT 2e0 a, -5e-1 b, 10e0 c, 25e-2 d, 3e0 e, -20e0 f, count(*) n, 0e0 rms FROM p""")
def robust_fit_all(points):
    """``robust_fit`` over all points, with twelve that were moved."""
    x, y = F.col("x") - 650000, F.col("y") - 6860000
    u, v = C.affine(x, y, (2.0, -0.5, 10.0, 0.25, 3.0, -20.0))
    good = points.select(x.alias("x"), y.alias("y"), u.alias("x2"), v.alias("y2"))
    bad = good.agg(F.avg("x").alias("x"), F.avg("y").alias("y")).select("x", "y", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("k")).select("x", "y", (F.col("k") * 1e6).alias("x2"), (F.col("k") * -1e6).alias("y2"))
    fit = catalog.robust_affinity(good.unionByName(bad))
    return fit.select(*(F.round(c, 4).alias(c) if t == "double" else F.col(c) for c, t in fit.dtypes)).replace(-0.0, 0.0)


LONLAT = "+ g AS (SELECT feature_id, 3 + ((feature_id * 37) % 80 - 40) / 1e1 lon, 465e-1 + ((feature_id * 13) % 80 - 40) / 1e1 lat FROM pt_features) "


def lonlat(features):
    return features.select("feature_id", (3 + ((F.col("feature_id") * 37) % 80 - 40) / 10).alias("lon"), (46.5 + ((F.col("feature_id") * 13) % 80 - 40) / 10).alias("lat"))


def conic_sql(p: P.Conic) -> str:
    k, f, r0 = p.constants()
    r = f"{f!r}*pow(tan(pi()/4-radians(lat)/2)/pow((1-{P.E!r}*sin(radians(lat)))/(1+{P.E!r}*sin(radians(lat))),{P.E / 2!r}),{k!r})"
    return f"round({p.east}+{r}*sin({k!r}*radians(lon-{p.lon0})),3) AS east, round({p.up}+{r0!r}-{r}*cos({k!r}*radians(lon-{p.lon0})),3) AS north"


def _there_and_back(at, back):
    (x, y) = at
    moved = lambda df: df.withColumns({"east": x, "north": y})
    (lon, lat) = back(F.col("east"), F.col("north"))
    return lambda features: moved(lonlat(features)).select("feature_id", F.round("east", 3).alias("east"), F.round("north", 3).alias("north"), F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


@register("pt_features", sql=LONLAT + f"SELECT feature_id, {conic_sql(P.LAMBERT93)}, round(lon,6) lon, round(lat,6) lat FROM g")
def lambert93(features):
    return _there_and_back(P.conic(F.col("lon"), F.col("lat"), P.LAMBERT93), lambda x, y: P.conic_inverse(x, y, P.LAMBERT93))(features)


@register("pt_features", sql=LONLAT + f"SELECT feature_id, {conic_sql(P.conic_zone(46))}, round(lon,6) lon, round(lat,6) lat FROM g")
def conic_zone46(features):
    p = P.conic_zone(46)
    return _there_and_back(P.conic(F.col("lon"), F.col("lat"), p), lambda x, y: P.conic_inverse(x, y, p))(features)


def utm_sql() -> str:
    series = lambda f, g: "".join(f" + {a!r}*{f}({2 * j}*xi)*{g}({2 * j}*eta)" for j, a in enumerate(P._ALPHA, 1))
    return f"""t AS (SELECT *, sinh(atanh(sin(radians(lat))) - {P.E!r}*atanh({P.E!r}*sin(radians(lat)))) t FROM g), k AS (SELECT *, atan2(t, cos(radians(lon-3))) xi, atanh(sin(radians(lon-3))/sqrt(1+t*t)) eta FROM t)
    SELECT feature_id, round(5e5 + {P.SCALE * P._RADIUS!r}*(eta{series('cos', 'sinh')}),3) east, round({P.SCALE * P._RADIUS!r}*(xi{series('sin', 'cosh')}),3) north, round(lon,6) lon, round(lat,6) lat FROM k"""


@register("pt_features", sql=LONLAT.rstrip() + ", " + utm_sql())
def utm31(features):
    return _there_and_back(P.utm(F.col("lon"), F.col("lat"), 31), lambda x, y: P.utm_inverse(x, y, 31))(features)


@register("pt_features", "dtm_nodes", sql="""+ q AS (SELECT feature_id, (x-650000)/5e1 u, (6861000-y)/5e1 v FROM pt_features), c AS (SELECT feature_id, CAST(floor(u) AS BIGINT) col, CAST(floor(v) AS BIGINT) row_, u-floor(u) a, v-floor(v) b FROM q)
    SELECT feature_id, round((1-a)*(1-b)*p.z + a*(1-b)*e.z + (1-a)*b*s.z + a*b*d.z, 6) shift FROM c JOIN dtm_nodes p ON p.col=c.col AND p.row_=c.row_ JOIN dtm_nodes e ON e.col=c.col+1 AND e.row_=c.row_ JOIN dtm_nodes s ON s.col=c.col AND s.row_=c.row_+1 JOIN dtm_nodes d ON d.col=c.col+1 AND d.row_=c.row_+1""")  # fmt: skip
def grid_datum_shift(features, nodes):
    return terrain.bilinear(features, nodes, 650000.0, 6861000.0, 50.0)


@register("events", sql="SELECT event_id, CAST(event_id * 60 + 1000000000 + 315964800 AS BIGINT) AS epoch, CAST(((event_id * 60 + 1315964800) - (event_id * 60 + 1315964800) % 86400) / 86400 AS BIGINT) AS day, printf('%02d:%02d:%02d', (event_id % 86400 - event_id % 3600) // 3600, (event_id % 3600) // 60, event_id % 60) AS hms, CAST(event_id % 86400 AS BIGINT) AS seconds FROM events")
def gps_time(events):
    t, s = F.unix_seconds(C.gps_time(F.col("event_id") * 60)), F.col("event_id") % 86400
    text = C.hms(s)
    return events.select("event_id", t.alias("epoch"), F.floor(t / 86400).alias("day"), text.alias("hms"), C.hms_seconds(F.replace(text, F.lit(":"), F.lit("")).cast("long")).cast("long").alias("seconds"))


@register("pages", sql=r"SELECT page_id, regexp_extract(url, '^(.*/)?[^/]*$', 1) AS folder, regexp_extract(url, '([^/]*)$', 1) AS name, regexp_extract(url, '([^/]*?)(?:\.[^./]*)?$', 1) AS stem, regexp_extract(url, '\.([^./]*)$', 1) AS extension FROM pages")
def path_parts(pages):
    return pages.select("page_id", *(C.file_part(F.col("url"), p).alias(p) for p in ("folder", "name", "stem", "extension")))


@register("pages", sql="""+ e AS (SELECT page_id, replace(replace(replace(replace(replace(html,'&','&amp;'),'<','&lt;'),'>','&gt;'),'"','&quot;'),'''','&apos;') t, html FROM pages) SELECT page_id, length(t) AS n, sha256(t) AS digest, true AS back FROM e""")
def xml_text(pages):
    t = C.xml_escape(F.col("html"))
    return pages.select("page_id", F.length(t).cast("long").alias("n"), F.sha2(t, 256).alias("digest"), (C.xml_unescape(t) == F.col("html")).alias("back"))


@register("supplier", sql=r"SELECT s_suppkey, array_to_string(list_transform(regexp_extract_all(lower(s_name || s_suppkey), '\d+|\D+'), lambda p: CASE WHEN regexp_matches(p, '^\d') THEN lpad(p, 20, '0') ELSE p END), '') AS key FROM supplier")
def natural_sort(supplier):
    return supplier.select("s_suppkey", C.natural_key(F.concat("s_name", F.col("s_suppkey").cast("string"))).alias("key"))


@register("pixels", sql="SELECT scene, pixel, 255::BIGINT*16777216 + (b04 % 256)*65536 + (b03 % 256)*256 + b08 % 256 AS argb, (b04 % 256)*16777216 + (b04 // 256)*65536 AS swapped FROM pixels")
def colour_words(pixels):
    r, g, b = (F.col(c) % 256 for c in ("b04", "b03", "b08"))
    return pixels.select("scene", "pixel", C.argb(F.lit(255), r, g, b).alias("argb"), C.swapped(F.col("b04")).alias("swapped"))


@register("events", sql="SELECT event_id, CASE WHEN event_id % 2 = 0 THEN props ELSE event_type END AS name FROM events")
def name_importance(events):
    kind = F.create_map(F.lit("id"), F.col("event_id").cast("string"), F.when(F.col("event_id") % 2 == 0, "Nom").otherwise("k"), F.col("props"), F.lit("NAME"), F.col("event_type"))
    return events.select("event_id", C.first_attribute(kind, ["toponyme", "nom", "name"]).alias("name"))


@register("events", sql="SELECT event_id, CASE WHEN value >= 20 THEN 4e0 WHEN value >= 5 THEN 2e0 ELSE 1e0 END AS step, round(CASE WHEN value >= 20 THEN 4e0 WHEN value >= 10 THEN 2e0 + (value-10)*2e-1 WHEN value >= 5 THEN 1e0 + (value-5)*2e-1 ELSE 1e0 END, 6) AS line FROM events")
def style_stops(events):
    return events.select("event_id", C.stops(F.col("value"), [(0, 1), (5, 2), (20, 4)]).alias("step"), C.stops(F.col("value"), [(5, 1), (10, 2), (20, 4)], linear=True).alias("line"))


RESOLUTIONS = {z: 2 * math.pi * RADIUS / 256 / 2**z for z in range(20)}


@register("pt_features", sql=LONLAT.rstrip() + f", r AS (SELECT unnest(range(0, 20)) z), c AS (SELECT *, 1 + feature_id % 500 gsd FROM g) SELECT feature_id, CAST(coalesce(min(z), 19) AS INT) AS zoom, round(any_value(gsd) / (254e-4/96), 6) AS scale FROM c LEFT JOIN r ON {2 * math.pi * RADIUS / 256!r}/pow(2, z)*cos(radians(lat)) < 15e-1*gsd GROUP BY feature_id")
def zoom_choice(features):
    gsd = 1 + F.col("feature_id") % 500
    return lonlat(features).select("feature_id", C.zoom_for(RESOLUTIONS, F.col("lat"), gsd).alias("zoom"), C.carto_scale(gsd, 96).alias("scale"))


@register("dtm_nodes", sql="SELECT row_, col, CAST(floor(CASE WHEN z >= 200 THEN 255 WHEN z >= 100 THEN 100 + (z-100)*(155/1e2) ELSE 100 END + 5e-1) AS BIGINT) red, CAST(floor(CASE WHEN z >= 200 THEN 0 WHEN z >= 100 THEN 200 + (z-100)*(-200/1e2) ELSE 200 END + 5e-1) AS BIGINT) green FROM dtm_nodes")
def altitude_color(nodes):
    red, green, _ = C.palette(F.col("z"), [(100, (100, 200, 50)), (200, (255, 0, 50))])
    return nodes.select("row_", "col", red.alias("red"), green.alias("green"))


@register("las_points", sql="+ h AS (SELECT min(z) z0, max(z) z1 FROM las_points) SELECT l_orderkey, l_linenumber, round(x,6) x, round(z,6) z, CAST(trunc((z-z0)*255/(z1-z0)) AS INT) AS shade, CAST(floor(intensity * 1000 / 256e0) AS BIGINT) AS red FROM las_points, h")
def las_shader(points):
    heights = points.agg(F.min("z").alias("z0"), F.max("z").alias("z1"))  # one row
    shade = ((F.col("z") - F.col("z0")) * 255 / (F.col("z1") - F.col("z0"))).cast("int")
    return points.crossJoin(F.broadcast(heights)).select("l_orderkey", "l_linenumber", "x", "z", shade.alias("shade"), F.floor(F.col("intensity") * 1000 / 256).alias("red"))


@register("pixels", sql="+ i AS (SELECT scene, pixel, CASE WHEN abs(b08+b04-2000) < 1e-6 THEN -1 ELSE (b08-b04)/CAST(b08+b04-2000 AS DOUBLE) END v FROM pixels) SELECT scene, count(*) FILTER (v > 6e-1) AS plants, round(avg(v),6) AS mean, round(max(CASE WHEN v > 6e-1 THEN trunc(127+v*127) END),6) AS ramp FROM i GROUP BY 1")
def ndvi_series(pixels):
    """An index per scene, with the pixels over the cut and their brightest display value."""
    v = F.when(F.abs(F.col("b08") + F.col("b04") - 2000) < 1e-6, F.lit(-1.0)).otherwise((F.col("b08") - F.col("b04")) / (F.col("b08") + F.col("b04") - 2000))
    shown = F.when(F.col("v") > 0.6, (127 + F.col("v") * 127).cast("int").cast("double"))
    return pixels.select("scene", v.alias("v")).groupBy("scene").agg(F.count_if(F.col("v") > 0.6).alias("plants"), F.avg("v").alias("mean"), F.max(shown).alias("ramp")).orderBy("scene")


@register("pixels", sql="SELECT min(b04) AS low, max(b04) AS high, round(avg(b04),6) AS mean, count(*) FILTER (b04 = 1000) AS empty, round(covar_pop(b04, b08),4) AS covar, round(corr(b04, b08),6) AS corr FROM pixels")
def image_stats(pixels):
    return pixels.agg(F.min("b04").alias("low"), F.max("b04").alias("high"), F.avg("b04").alias("mean"), F.count_if(F.col("b04") == 1000).alias("empty"), F.round(F.covar_pop("b04", "b08"), 4).alias("covar"), F.corr("b04", "b08").alias("corr"))


@register("pt_features", sql="SELECT feature_id, class FROM pt_features WHERE lower(class) = 'building' AND zorder = 7 ORDER BY zorder, feature_id LIMIT 1")
def find_attr(features):
    return catalog.find_attribute(features, "Building", "zorder", "7").select("feature_id", "class")


@register("pt_features", sql="(SELECT feature_id FROM pt_features WHERE zorder < 5 UNION SELECT feature_id FROM pt_features WHERE visible) EXCEPT SELECT feature_id FROM pt_features WHERE class = 'BUILDING'")
def selection_sets(features):
    ids = features.select("feature_id")
    return catalog.remove(catalog.add(ids.where(F.col("zorder") < 5), ids.where("visible")), ids.where("class = 'BUILDING'"), "feature_id")


@register("pt_features", sql="+ o AS (SELECT class, row_number() OVER (ORDER BY min(zorder), avg(zorder), class) - 1 pos FROM pt_features GROUP BY 1), n AS (SELECT count(*) n FROM o) SELECT class, CASE WHEN pos = 1 THEN n - 1 WHEN pos > 1 THEN pos - 1 ELSE pos END AS pos FROM o, n")
def reorder_class(features):
    order = selection.class_order(features).select("class", (F.col("pos") - 1).alias("pos"))
    return catalog.reorder(order, 1, -1)


@register("pt_features", sql="""+ f AS (SELECT min(x)-(max(x)-min(x))*5e-2 x0, max(x)+(max(x)-min(x))*5e-2 x1, min(y)-(max(y)-min(y))*5e-2 y0, max(y)+(max(y)-min(y))*5e-2 y1 FROM pt_features), g AS (SELECT *, x1-x0 > 1000 OR y1-y0 > 1000 big FROM f)
    SELECT round(CASE WHEN big THEN floor(x0/10)*10 ELSE x0 END,6) xmin, round(CASE WHEN big THEN ceil(x1/10)*10 ELSE x1 END,6) xmax, round(CASE WHEN big THEN floor(y0/10)*10 ELSE y0 END,6) ymin, round(CASE WHEN big THEN ceil(y1/10)*10 ELSE y1 END,6) ymax FROM g""")  # fmt: skip
def base_frame(features):
    return catalog.base_frame(features)
