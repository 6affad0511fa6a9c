"""Queries over line features (an order's points in line order) and over elevation stacks."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.functions import geometry as G
from geoloom.functions import shapes as S
from geoloom.operators import lines, nearest, terrain
from geoloom.plans.registry import inside, register

FRAME = G.Frame(650200.0, 6860100.0, 650700.0, 6860600.0)
RING = [(650100.0, 6860100.0), (650300.0, 6860900.0), (650900.0, 6860700.0), (650600.0, 6860050.0), (650100.0, 6860100.0)]
X, Y, DIST = 650400.0, 6860400.0, 15.0

V = "+ v AS (SELECT l_orderkey id, l_linenumber k, x, y, z FROM las_points), "
SEG = V + """s AS (SELECT *, lead(x) OVER w x2, lead(y) OVER w y2, lead(z) OVER w z2, first_value(x) OVER w x0, first_value(y) OVER w y0 FROM v WINDOW w AS (PARTITION BY id ORDER BY k, x, y, z)) """


def crossing(ax: str, ay: str, bx: str, by: str) -> str:
    out = []
    for (px, py), (qx, qy) in zip(RING, RING[1:], strict=False):
        side = lambda x, y: f"(({bx}-{ax})*({y}-{ay})-({by}-{ay})*({x}-{ax}))"
        edge = lambda x, y: f"(({qx}-{px})*({y}-{py})-({qy}-{py})*({x}-{px}))"
        out.append(f"({side(px, py)}*{side(qx, qy)} < 0 AND {edge(ax, ay)}*{edge(bx, by)} < 0)")
    return "(" + " OR ".join(out) + ")"


def in_ring_sql(x: str = "x", y: str = "y") -> str:
    out = []
    for (ax, ay), (bx, by) in zip(RING, RING[1:], strict=False):
        au, bu = ax - ay, bx - by
        out.append(f"CASE WHEN (({au} <= {x} - {y}) <> ({bu} <= {x} - {y})) AND {ax + ay} + ({x} - {y} - ({au})) / ({bu - au}) * ({bx + by - ax - ay}) > {x} + {y} THEN 1 ELSE 0 END")
    return "((" + " + ".join(out) + ") % 2 = 1)"


@register("las_points", sql=SEG + """, e AS (SELECT *, coalesce(x2, x0) xn, coalesce(y2, y0) yn FROM s)
    SELECT id, count(*) n, round(sum(coalesce(sqrt((x2-x)*(x2-x)+(y2-y)*(y2-y)),0)),6) length, round(sum(coalesce(sqrt((x2-x)*(x2-x)+(y2-y)*(y2-y)+(z2-z)*(z2-z)),0)),6) length3d,
    round(sum((xn-x)*(yn-y0+y-y0)/2),6)+0e0 area, round(sqrt(sum(coalesce((x2-x)*(x2-x)+(y2-y)*(y2-y),0))),6) edges, round(avg(x),6) cx, round(avg(y),6) cy FROM e GROUP BY id""")  # fmt: skip
def line_measures(points):
    return lines.measures(lines.build(points))


@register("las_points", sql=SEG + f"SELECT DISTINCT id FROM s WHERE x2 IS NOT NULL AND least(x,x2)-{DIST} <= {X} AND greatest(x,x2)+{DIST} >= {X} AND least(y,y2)-{DIST} <= {Y} AND greatest(y,y2)+{DIST} >= {Y} AND (x2-x)*(x2-x)+(y2-y)*(y2-y) > 0 AND ((x2-x)*({Y}-y)-(y2-y)*({X}-x))*((x2-x)*({Y}-y)-(y2-y)*({X}-x)) <= {DIST * DIST}*((x2-x)*(x2-x)+(y2-y)*(y2-y))")
def find_near_lines(points):
    return lines.build(points).where(S.near_line(F.col("pts"), X, Y, DIST)).select("id")


@register("las_points", sql=V + f"b AS (SELECT id, min(x) x0, max(x) x1, min(y) y0, max(y) y1, bool_or({inside(FRAME)}) hit FROM v GROUP BY 1) SELECT id FROM b WHERE x0 <= {FRAME.xmax} AND x1 >= {FRAME.xmin} AND y0 <= {FRAME.ymax} AND y1 >= {FRAME.ymin} AND hit")
def select_lines(points):
    return lines.select_lines(lines.build(points), FRAME).select("id")


@register("las_points", sql=V + f"b AS (SELECT id, min(x) x0, max(x) x1, min(y) y0, max(y) y1 FROM v GROUP BY 1) SELECT count(*) n, count(*) > 0 AS some FROM b WHERE x0 <= {FRAME.xmax} AND x1 >= {FRAME.xmin} AND y0 <= {FRAME.ymax} AND y1 >= {FRAME.ymin}")
def count_in_frame(points):
    return lines.build(points).where(S.meets_frame(S.bounds(F.col("pts")), FRAME)).agg(F.count("*").alias("n"), (F.count("*") > 0).alias("some"))


@register("las_points", sql=SEG + f"SELECT id FROM s GROUP BY id HAVING bool_or({in_ring_sql()}) OR coalesce(bool_or(x2 IS NOT NULL AND {crossing('x', 'y', 'x2', 'y2')}), false)")
def hide_out_poly(points):
    return lines.hide_out(lines.build(points), RING).select("id")


@register("las_points", sql=SEG + f"SELECT id FROM s GROUP BY id HAVING bool_and({in_ring_sql()}) AND NOT coalesce(bool_or(x2 IS NOT NULL AND {crossing('x', 'y', 'x2', 'y2')}), false)")
def hide_out_strict(points):
    return lines.hide_out(lines.build(points), RING, strict=True).select("id")


@register("las_points", "pt_features", sql=V + """o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY k, x, y, z) a, row_number() OVER (PARTITION BY id ORDER BY k DESC, x DESC, y DESC, z DESC) b FROM v)
    SELECT DISTINCT f.feature_id, o.id FROM o JOIN pt_features f ON floor(f.x) = floor(o.x) AND floor(f.y) = floor(o.y) WHERE a = 1 OR b = 1""")  # fmt: skip
def find_connection(points, features):
    """Features whose square metre holds an end of a line: an equi-join on the snapped place."""
    pts = F.col("pts")
    ends = lines.build(points).select("id", F.explode(F.array(pts[0], F.element_at(pts, -1))).alias("e")).select("id", F.floor("e.x").alias("u"), F.floor("e.y").alias("v"))
    return features.select("feature_id", F.floor("x").alias("u"), F.floor("y").alias("v")).join(ends, ["u", "v"]).select("feature_id", "id").distinct()


@register("las_points", sql=SEG + """, d AS (SELECT *, sqrt((x2-x)*(x2-x)+(y2-y)*(y2-y)) d FROM s WHERE x2 IS NOT NULL), n AS (SELECT *, CAST(floor(d/25e0+5e-1) AS INT) n, row_number() OVER (PARTITION BY id ORDER BY k, x, y, z) sk FROM d WHERE d >= 25),
    p AS (SELECT id, sk, j, n, x+(x2-x)*j/n x, y+(y2-y)*j/n y FROM (SELECT *, unnest(range(0, n)) j FROM n)) SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY sk, j) - 1 AS INT) k, round(x+1e-9,6) x, round(y+1e-9,6) y FROM p""")  # fmt: skip
def sample_line(points):
    return lines.sample(lines.build(points), 25.0).withColumns({c: F.col(c) + 1e-9 for c in "xy"})  # a half at the seventh place rounds up on both sides


@register("las_points", sql=V + "sized AS (SELECT id, max(x)-min(x)+max(y)-min(y) size FROM v GROUP BY 1) SELECT id, round(size,6) size FROM sized ORDER BY sized.size DESC, id")
def sort_size(points):
    return lines.by_size(lines.build(points))


@register("las_points", sql=V + "sized AS (SELECT id, max(x)-min(x)+max(y)-min(y) size FROM v GROUP BY 1) SELECT id, round(size,6) size FROM sized ORDER BY sized.size DESC, id")
def sort_size_all(points):
    """All lines in order: a sort over ranges."""
    return lines.by_size(lines.build(points))


@register("pt_features", "dtm_nodes", sql="""SELECT f.feature_id, f.class, round(f.z - d.z, 6) delta FROM pt_features f JOIN dtm_nodes d ON CAST(floor((f.x - 650000)/5e1 + 5e-1) AS BIGINT) = d.col AND CAST(floor((6861000 - f.y)/5e1 + 5e-1) AS BIGINT) = d.row_
    WHERE f.z > -99 AND d.z > -99 AND abs(d.z - f.z) >= 50""")  # fmt: skip
def delta_dtm_vector(features, nodes):
    return nearest.delta_to_grid(features, nodes, 650000.0, 6861000.0, 50.0, 50.0)


@register("pt_features", "dtm_nodes", sql="""+ stack AS (SELECT 0 dtm, row_, col, z FROM dtm_nodes WHERE (row_ + col) % 3 <> 0 UNION ALL SELECT 1, row_, col, z + 1000 FROM dtm_nodes WHERE (row_ + col) % 2 = 0),
    f AS (SELECT feature_id, CAST(floor((x - 650000)/5e1 + 5e-1) AS BIGINT) col, CAST(floor((6861000 - y)/5e1 + 5e-1) AS BIGINT) row_ FROM pt_features)
    SELECT feature_id, round(arg_min(s.z, s.dtm), 6) z FROM f LEFT JOIN stack s ON f.row_ = s.row_ AND f.col = s.col GROUP BY 1""")  # fmt: skip
def priority_z(features, nodes):
    """Two grids with holes: the first that has a height counts."""
    first = nodes.where((F.col("row_") + F.col("col")) % 3 != 0).withColumn("dtm", F.lit(0))
    second = nodes.where((F.col("row_") + F.col("col")) % 2 == 0).withColumn("z", F.col("z") + 1000).withColumn("dtm", F.lit(1))
    return nearest.first_height(features, first.unionByName(second), 650000.0, 6861000.0, 50.0)


@register("dtm_nodes", sql="+ b AS (SELECT row_, col + 1 AS col, z z0 FROM dtm_nodes) SELECT row_, col, round(z - z0, 6) diff FROM dtm_nodes JOIN b USING (row_, col)")
def dtm_diff(nodes):
    """The grid less itself moved by one column."""
    return terrain.difference(nodes, nodes.withColumn("col", F.col("col") + 1))


@register("tracks", sql="""+ r AS (SELECT track_id, first_value(x) OVER w x0, first_value(y) OVER w y0, x, y, z, seq FROM tracks WINDOW w AS (PARTITION BY track_id ORDER BY seq)), l AS (SELECT track_id, seq, x, y, z, lead(x) OVER w x2, lead(y) OVER w y2, lead(z) OVER w z2 FROM r WINDOW w AS (PARTITION BY track_id ORDER BY seq))
    SELECT track_id, seq, round(sqrt((x2-x)*(x2-x)+(y2-y)*(y2-y)),6) run, round(z2-z,6) rise, CASE WHEN (x2-x)*(x2-x)+(y2-y)*(y2-y) > 0 THEN round((z2-z)/sqrt((x2-x)*(x2-x)+(y2-y)*(y2-y)),6) END slope FROM l WHERE x2 IS NOT NULL""")  # fmt: skip
def leg_slopes(tracks):
    return terrain.slopes(tracks)


@register("zones", sql="SELECT a.zone_id, b.zone_id AS other FROM zones a JOIN zones b ON a.zone_id <> b.zone_id AND a.xmin <= b.xmax AND a.xmax >= b.xmin AND a.ymin <= b.ymax AND a.ymax >= b.ymin")
def zone_neighbours(zones):
    """Frames that touch: zones meet in the cells that they cover."""
    return nearest.touching(zones)
