"""Queries of simplified lines, their crossings and label places, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.operators import lines, order, outlines
from geoloom.plans.registry import register

TOLERANCE = 150.0
Z = (20.0, 80.0)  # heights of a flight


@register("las_points", sql=f"""+ v AS (SELECT l_orderkey AS id, row_number() OVER w - 1 AS seg, x, y, CASE WHEN z >= {Z[0]} THEN z ELSE {sum(Z) / 2} END AS z, lead(x) OVER w AS x2, lead(y) OVER w AS y2, lead(CASE WHEN z >= {Z[0]} THEN z ELSE {sum(Z) / 2} END) OVER w AS z2
        FROM las_points WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, x, y, z)),
    d AS (SELECT *, sqrt((x2 - x)*(x2 - x) + (y2 - y)*(y2 - y)) AS d FROM v WHERE x2 IS NOT NULL), s AS (SELECT *, greatest(1, CAST(floor(sum(d) OVER (PARTITION BY id) / 12e2 + 5e-1) AS BIGINT)) AS step, greatest(1, CAST(floor(d + 5e-1) AS BIGINT)) AS far FROM d),
    p AS (SELECT *, unnest(range(0, far, step)) AS k FROM s)
    SELECT id, count(*) AS n, CAST(floor(sum(k)) AS BIGINT) AS total, round(min((x * (far - k) + x2 * k) / far), 3) AS x, round(max((y * (far - k) + y2 * k) / far), 3) AS y, round(max((z * (far - k) + z2 * k) / far), 3) AS z FROM p GROUP BY id""")  # fmt: skip
def fly_paths(points: DataFrame) -> DataFrame:
    """Of the flight along each line: pictures, sum of their metres, and the ends of its places."""
    path = lines.fly_path(lines.build(points), *Z)
    return path.groupBy("id").agg(F.count("*").alias("n"), F.sum("k").alias("total"), F.round(F.min("x"), 3).alias("x"), F.round(F.max("y"), 3).alias("y"), F.round(F.max("z"), 3).alias("z"))


_NATURAL = r"array_to_string(list_transform(regexp_extract_all(lower(t), '\d+|\D+'), lambda p: CASE WHEN regexp_matches(p, '^\d') THEN '0' || lpad(length(regexp_replace(p, '^0+(.)', '\1'))::VARCHAR, 8, '0') || regexp_replace(p, '^0+(.)', '\1') ELSE p END), '')"


@register("customer", sql=f"SELECT c_custkey, row_number() OVER (ORDER BY {_NATURAL} DESC, t DESC, c_custkey DESC) AS pos FROM (SELECT c_custkey, 'Item ' || c_custkey % 97 || ' no ' || c_custkey * 7919 AS t FROM customer)")
def natural_places(customers: DataFrame) -> DataFrame:
    """Places in descending natural order of a text with two numbers."""
    named = customers.select("c_custkey", F.concat(F.lit("Item "), (F.col("c_custkey") % 97).cast("string"), F.lit(" no "), (F.col("c_custkey") * 7919).cast("string")).alias("t"))
    return order.natural_order(named, "t", "c_custkey", True).select("c_custkey", "pos")


_V = "+ v AS (SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, x, y, z) - 1 AS k, x, y FROM las_points)"


@register("las_points", sql=_V + f""", c AS (SELECT a.id, a.k AS lo, b.k AS hi, m.k AS mid, m.x - a.x AS px, m.y - a.y AS py, b.x - a.x AS bx, b.y - a.y AS by_ FROM v a JOIN v b ON a.id = b.id AND b.k > a.k + 1 JOIN v m ON m.id = a.id AND m.k > a.k AND m.k < b.k),
    t AS (SELECT *, CASE WHEN bx*bx + by_*by_ > 0 THEN least(1, greatest(0, (px*bx + py*by_) / (bx*bx + by_*by_))) ELSE 0 END AS t FROM c),
    f AS (SELECT id, lo, hi, mid FROM t QUALIFY row_number() OVER (PARTITION BY id, lo, hi ORDER BY (px - t*bx)*(px - t*bx) + (py - t*by_)*(py - t*by_) DESC, mid) = 1 AND (px - t*bx)*(px - t*bx) + (py - t*by_)*(py - t*by_) > {TOLERANCE**2}),
    w AS (WITH RECURSIVE w AS (SELECT id, CAST(0 AS BIGINT) AS lo, max(k) AS hi FROM v GROUP BY id UNION ALL SELECT f.id, CASE WHEN s = 0 THEN f.lo ELSE f.mid END, CASE WHEN s = 0 THEN f.mid ELSE f.hi END FROM w JOIN f USING (id, lo, hi), range(2) r(s)) SELECT * FROM w)
    SELECT id, CAST(k AS INT) AS at, round(x, 6) AS x, round(y, 6) AS y FROM v SEMI JOIN (SELECT id, lo AS k FROM w UNION SELECT id, hi FROM w) USING (id, k)""")  # fmt: skip
def generalised(points: DataFrame) -> DataFrame:
    """Lines simplified within 150 m."""
    return outlines.generalised(lines.build(points), TOLERANCE)


def _turn(a: str, b: str, q: str) -> str:
    return f"(({b[0]}-{a[0]})*({q[1]}-{a[1]}) - ({b[1]}-{a[1]})*({q[0]}-{a[0]}))"


_P, _Q, _R, _S = ("a.x", "a.y"), ("a.x2", "a.y2"), ("b.x", "b.y"), ("b.x2", "b.y2")


@register("las_points", sql=_V + f""", s AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2, max(k) OVER (PARTITION BY id) AS n, first(x) OVER w AS x0, first(y) OVER w AS y0 FROM v WINDOW w AS (PARTITION BY id ORDER BY k))
    SELECT a.id, CAST(a.k AS INT) AS i, CAST(b.k AS INT) AS j FROM s a JOIN s b ON a.id = b.id AND a.k + 1 < b.k WHERE b.x2 IS NOT NULL AND NOT (a.k = 0 AND b.k = b.n - 1 AND b.x2 = a.x0 AND b.y2 = a.y0)
    AND least(a.x, a.x2) <= greatest(b.x, b.x2) AND least(b.x, b.x2) <= greatest(a.x, a.x2) AND least(a.y, a.y2) <= greatest(b.y, b.y2) AND least(b.y, b.y2) <= greatest(a.y, a.y2)
    AND {_turn(_P, _Q, _R)} * {_turn(_P, _Q, _S)} <= 0 AND {_turn(_R, _S, _P)} * {_turn(_R, _S, _Q)} <= 0""")  # fmt: skip
def self_crossings(points: DataFrame) -> DataFrame:
    """Segments of a line that meet others of it."""
    return outlines.crossings(lines.build(points)).select("id", "i", "j")


@register("las_points", sql=_V + """, f AS (SELECT id, (min(x) + max(x)) / 2 AS cx, (min(y) + max(y)) / 2 AS cy FROM v GROUP BY id),
    e AS (SELECT id, x, y, lead(x, 1, x0) OVER w AS x2, lead(y, 1, y0) OVER w AS y2 FROM (SELECT *, first(x) OVER u AS x0, first(y) OVER u AS y0 FROM v WINDOW u AS (PARTITION BY id ORDER BY k)) WINDOW w AS (PARTITION BY id ORDER BY k)),
    c AS (SELECT id, x + (cy - y) / (y2 - y) * (x2 - x) AS xx FROM e JOIN f USING (id) WHERE (y <= cy) <> (y2 <= cy)), r AS (SELECT id, xx, lead(xx) OVER w AS to_, row_number() OVER w AS k FROM c WINDOW w AS (PARTITION BY id ORDER BY xx)),
    b AS (SELECT id, (xx + to_) / 2 AS x FROM r WHERE k % 2 = 1 QUALIFY row_number() OVER (PARTITION BY id ORDER BY to_ - xx DESC, k) = 1)
    SELECT id, CAST(floor(coalesce(b.x, cx) * 1000 + 5e-1) AS BIGINT) AS x_mm, CAST(floor(cy * 1000 + 5e-1) AS BIGINT) AS y_mm FROM f LEFT JOIN b USING (id)""")  # fmt: skip
def label_points(points: DataFrame) -> DataFrame:
    """A place for the label of each line taken as a ring, in millimetres (doubles that end in a half are rounded differently by engines)."""
    return outlines.label_points(lines.build(points)).select("id", *(F.floor(F.col(c) * 1000 + 0.5).alias(f"{c}_mm") for c in "xy"))
