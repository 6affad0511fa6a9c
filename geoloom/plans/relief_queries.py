"""Queries of contour lines, floods and ways down over the elevation grid, with their SQL: marching squares and recursive walks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.operators import relief
from geoloom.plans.registry import register

STEP, LEVELS, SIDE = 5.0, (9.0, 14.0, 19.0), 64

_SEGMENTS = """+ c AS (SELECT a.row_ AS r, a.col AS c, [a.z, b.z, d.z, e.z] AS z FROM hills a JOIN hills b ON b.row_ = a.row_ AND b.col = a.col + 1
        JOIN hills d ON d.row_ = a.row_ + 1 AND d.col = a.col + 1 JOIN hills e ON e.row_ = a.row_ + 1 AND e.col = a.col),
    h AS (SELECT r, c, k, list_transform(z, lambda x: x >= k * 5) AS high, list_sum(z) / 4 >= k * 5 AS middle FROM c, LATERAL (SELECT unnest(range(CAST(floor(list_min(z) / 5) AS BIGINT), CAST(ceil(list_max(z) / 5) AS BIGINT) + 1)) AS k)),
    w AS (SELECT h.*, p, q FROM h, range(4) a(p), range(4) b(q) WHERE high[p + 1] AND NOT high[(p + 1) % 4 + 1] AND NOT high[q + 1] AND high[(q + 1) % 4 + 1]
        AND (high[1] <> high[3] OR high[2] <> high[4] OR q = CASE WHEN middle THEN (p + 1) % 4 ELSE (p + 3) % 4 END)),
    s AS (SELECT k, (r + CASE WHEN p = 2 THEN 1 ELSE 0 END) * 8589934592 + (c + CASE WHEN p = 1 THEN 1 ELSE 0 END) * 2 + p % 2 AS a, (r + CASE WHEN q = 2 THEN 1 ELSE 0 END) * 8589934592 + (c + CASE WHEN q = 1 THEN 1 ELSE 0 END) * 2 + q % 2 AS b FROM w)"""


@register("hills", sql=_SEGMENTS + """,
    o AS (WITH RECURSIVE o AS (SELECT k, a AS line, a AS edge, CAST(0 AS BIGINT) AS seq FROM s ANTI JOIN (SELECT k, b AS a FROM s) t USING (k, a) UNION ALL SELECT o.k, line, s.b, seq + 1 FROM o JOIN s ON s.k = o.k AND s.a = o.edge) SELECT * FROM o),
    g AS (WITH RECURSIVE left_over AS (SELECT * FROM s ANTI JOIN (SELECT k, edge AS a FROM o) t USING (k, a)), g AS (SELECT k, a AS line, a AS edge, b AS then_, CAST(0 AS BIGINT) AS seq FROM left_over
        UNION ALL SELECT g.k, line, l.a, l.b, seq + 1 FROM g JOIN left_over l ON l.k = g.k AND l.a = g.then_ WHERE g.then_ <> line) SELECT * FROM g),
    f AS (SELECT k, line FROM g GROUP BY 1, 2 HAVING min(edge) = line),
    v AS (SELECT k, line, false AS closed, seq, edge FROM o UNION ALL SELECT k, line, true, seq, edge FROM g SEMI JOIN f USING (k, line)),
    e AS (SELECT *, edge // 8589934592 AS r, edge % 8589934592 // 2 AS c, edge % 2 AS below FROM v)
    SELECT k * 5e0 AS level, line, closed, seq, round(c + CASE WHEN below = 1 THEN 0 ELSE (k * 5 - p.z) / (n.z - p.z) END, 6) AS u, round(r + CASE WHEN below = 1 THEN (k * 5 - p.z) / (n.z - p.z) ELSE 0 END, 6) AS v
    FROM e JOIN hills p ON p.row_ = r AND p.col = c JOIN hills n ON n.row_ = r + below AND n.col = c + 1 - below""")  # fmt: skip
def contour_lines(nodes: DataFrame) -> DataFrame:
    return relief.contours(nodes, STEP, SIDE)


@register("hills", sql=f"""+ f AS (WITH RECURSIVE f AS (SELECT level, row_, col, z FROM hills, (SELECT unnest({list(LEVELS)}) AS level) WHERE (row_ * 20 + col) % 97 = 0 AND z <= level
        UNION SELECT f.level, n.row_, n.col, n.z FROM f JOIN hills n ON abs(n.row_ - f.row_) + abs(n.col - f.col) = 1 AND n.z <= f.level) SELECT * FROM f)
    SELECT CAST(level AS DOUBLE) AS level, row_, col, round(level - z, 6) AS depth FROM f""")  # fmt: skip
def flood_levels(nodes: DataFrame) -> DataFrame:
    """Three waters from a seed in 97 nodes."""
    seeds = nodes.where((F.col("row_") * 20 + F.col("col")) % 97 == 0)
    each = [relief.flood(nodes, seeds, level, SIDE).withColumn("level", F.lit(level)) for level in LEVELS]
    return reduce(DataFrame.unionByName, each)


_FALLS = """+ d AS (SELECT a.row_, a.col, b.row_ AS r2, b.col AS c2, (a.z - b.z) / CASE WHEN a.row_ <> b.row_ AND a.col <> b.col THEN sqrt(2e0) ELSE 1 END AS slope FROM hills a JOIN hills b ON b.row_ - a.row_ BETWEEN -1 AND 1 AND b.col - a.col BETWEEN -1 AND 1 AND b.z < a.z),
    t AS (SELECT row_, col, r2, c2 FROM d QUALIFY row_number() OVER (PARTITION BY row_, col ORDER BY slope DESC, r2, c2) = 1),
    w AS (WITH RECURSIVE w AS (SELECT row_ AS start_row, col AS start_col, row_, col, CAST(0 AS BIGINT) AS seq FROM hills UNION ALL SELECT start_row, start_col, r2, c2, seq + 1 FROM w JOIN t USING (row_, col)) SELECT * FROM w)"""


@register("hills", sql=_FALLS + "SELECT start_row AS row_, start_col AS col, arg_max(row_, seq) AS pit_row, arg_max(col, seq) AS pit_col, max(seq) AS steps FROM w GROUP BY start_row, start_col")
def descents(nodes: DataFrame) -> DataFrame:
    return relief.descents(nodes, SIDE)


@register("hills", sql=_FALLS + "SELECT start_row, start_col, seq, row_, col FROM w WHERE (start_row + start_col) % 13 = 0")
def thalwegs(nodes: DataFrame) -> DataFrame:
    """Ways down from a node in 13."""
    return relief.thalwegs(nodes, nodes.where((F.col("row_") + F.col("col")) % 13 == 0), SIDE)
