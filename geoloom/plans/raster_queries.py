"""Queries of blurred and sharpened rasters and of polygons as cells, with their SQL: recurrences as recursive queries, the parity rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.operators import blur, rasterise
from geoloom.plans.registry import register

RADIUS, SIDE = 3.0, 16


def _recurrences() -> tuple[str, str]:
    """The SQL of the passes over p0 (row_, col, v), and the name of the last table."""
    a, out, k = repr(blur.weight(RADIUS)), [], 0
    for _ in range(2):
        for line, at in (("row_", "col"), ("col", "row_")):
            for back in (False, True):
                prev, here = f"p{k}", f"p{k + 1}"
                begin = f"{at} = (SELECT max({at}) FROM p0)" if back else f"{at} = 0"
                step = f"n.{at} = f.{at} {'-' if back else '+'} 1" + f" AND n.{at} > 0" * back
                rest = f" UNION ALL SELECT * FROM {prev} WHERE {at} = 0" * back
                walk = f"WITH RECURSIVE f AS (SELECT row_, col, v FROM {prev} WHERE {begin} UNION ALL SELECT n.row_, n.col, {1 - float(a)!r} * n.v + {a} * f.v FROM f JOIN {prev} n ON n.{line} = f.{line} AND {step}) SELECT * FROM f"
                out.append(f"{here} AS MATERIALIZED (SELECT * FROM ({walk}){rest})")
                k += 1
    return ", ".join(out), f"p{k}"


_PASSES, _LAST = _recurrences()


@register("hills", sql=f"+ p0 AS MATERIALIZED (SELECT row_, col, z / 4e1 AS v FROM hills), {_PASSES} SELECT row_, col, round(v, 6) AS value FROM {_LAST}")
def blurred(nodes: DataFrame) -> DataFrame:
    return blur.blurred(nodes.select("row_", "col", (F.col("z") / 40).alias("value")), RADIUS, SIDE)


_POWER = 2.5 * 0.6**3 * 10
_SHARP = "least(1, greatest(0, {} + d))"


@register("hills", sql=f"""+ i AS (SELECT row_, col, z / 4e1 AS r, z / 5e1 AS g, 1 - z / 4e1 AS b FROM hills), p0 AS MATERIALIZED (SELECT row_, col, (r + g + b) / 3 AS v FROM i), {_PASSES},
    e AS (SELECT row_, col, r, g, b, (p0.v - l.v) * {_POWER!r} AS e FROM i JOIN p0 USING (row_, col) JOIN {_LAST} l USING (row_, col)),
    f AS (SELECT *, CASE WHEN abs(e) >= {2 * _POWER / 250!r} THEN e WHEN abs(e) > {_POWER / 250!r} THEN sign(e) * (abs(e) - {_POWER / 250!r}) * 2 ELSE 0 END AS d FROM e)
    SELECT row_, col, round({_SHARP.format('r')}, 6) AS r, round({_SHARP.format('g')}, 6) AS g, round({_SHARP.format('b')}, 6) AS b FROM f""")  # fmt: skip
def sharpened(nodes: DataFrame) -> DataFrame:
    z = F.col("z")
    return blur.sharpened(nodes.select("row_", "col", (z / 40).alias("r"), (z / 50).alias("g"), (1 - z / 40).alias("b")), RADIUS, 60.0, 2.0, SIDE)


RINGS = ([(10, 10), (190, 30), (180, 190), (100, 140), (20, 195)], [(60, 60), (60, 110), (120, 100)])  # metres from a zone's corner
_EDGES = [(*a, *b) for ring in RINGS for a, b in zip(ring, [*ring[1:], ring[0]], strict=True)]


@register("zones", sql=f"""+ e AS (SELECT unnest({[list(map(float, e)) for e in _EDGES]}) AS e), g AS (SELECT z.zone_id, r AS row_, c AS col, 650000e0 + c * 5 - z.xmin AS x, 6861000e0 - r * 5 - z.ymin AS y FROM range(200) a(r), range(200) b(c), zones z
        WHERE 650000e0 + c * 5 BETWEEN z.xmin AND z.xmax AND 6861000e0 - r * 5 BETWEEN z.ymin AND z.ymax)
    SELECT zone_id AS feature_id, row_, col FROM g, e WHERE (e[2] <= y) <> (e[4] <= y) AND e[1] + (y - e[2]) / (e[4] - e[2]) * (e[3] - e[1]) > x GROUP BY ALL HAVING count(*) % 2 = 1""")  # fmt: skip
def rasterised(zones: DataFrame) -> DataFrame:
    """Nodes 5 m apart inside a pentagon with a hole in each zone."""
    vertex = lambda p: F.struct((F.col("xmin") + float(p[0])).alias("x"), (F.col("ymin") + float(p[1])).alias("y"))
    rings = zones.select(F.col("zone_id").alias("feature_id"), F.explode(F.array(*(F.array(*map(vertex, ring)) for ring in RINGS))).alias("pts"))
    return rasterise.cells(rings, 650000.0, 6861000.0, 5.0, 200, 200)
