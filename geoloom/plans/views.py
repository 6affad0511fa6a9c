"""Geospatial views of the star-schema tables; expressions that read the same in Spark and in other SQL engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "las_points": ("lineitem", [
        "l_suppkey AS las_id", "l_orderkey", "l_linenumber",
        "650000e0 + ((l_orderkey*37 + l_linenumber*101) % 100000) / 1e2 AS x", "6860000e0 + ((l_partkey*53 + l_orderkey*7) % 100000) / 1e2 AS y",
        "l_extendedprice / 1e3 AS z", "l_linenumber AS classification", "CAST(l_quantity AS INT) AS intensity",
    ]),
    "pt_features": ("customer", [
        "c_custkey AS feature_id", "c_mktsegment AS class", "c_nationkey AS zorder",
        "650000e0 + ((c_custkey*97) % 100000) / 1e2 AS x", "6860000e0 + ((c_custkey*61) % 100000) / 1e2 AS y", "c_acctbal / 1e2 AS z",
        "(c_custkey % 7) <> 0 AS visible", "(c_custkey % 5) <> 0 AS selectable",
    ]),
    "zones": ("nation", [
        "n_nationkey AS zone_id", "n_name AS name", "n_regionkey AS layer",
        "650000e0 + (n_nationkey % 5) * 200 AS xmin", "6860000e0 + ((n_nationkey - n_nationkey % 5) / 5e0) * 200 AS ymin",
        "650000e0 + (n_nationkey % 5) * 200 + 200 AS xmax", "6860000e0 + ((n_nationkey - n_nationkey % 5) / 5e0) * 200 + 200 AS ymax",
    ]),
    "dtm_nodes": ("part", [
        "p_partkey % 20 AS col", "CAST((p_partkey - p_partkey % 20) / 20e0 AS BIGINT) AS row_",
        "650000e0 + (p_partkey % 20) * 50 AS x", "6861000e0 - ((p_partkey - p_partkey % 20) / 20e0) * 50 AS y", "p_retailprice / 1e1 AS z",
    ]),
    "hills": ("part", [
        "p_partkey % 20 AS col", "CAST((p_partkey - p_partkey % 20) / 20e0 AS BIGINT) AS row_",
        "abs((CAST((p_partkey - p_partkey % 20) / 20e0 AS BIGINT) * 3 + (p_partkey % 20) * 5) % 34 - 17) + abs((CAST((p_partkey - p_partkey % 20) / 20e0 AS BIGINT) * 5 + (p_partkey % 20) * 2) % 26 - 13) + p_size / 8e0 AS z",
    ]),
    "tracks": ("events", [
        "user_id AS track_id", "event_id AS seq", "event_type AS kind", "650000e0 + ((event_id*13) % 1000) AS x", "6860000e0 + ((event_id*29) % 1000) AS y", "value AS z",
    ]),
    "pixels": ("events", [
        "event_id % 64 AS scene", "CAST((event_id - event_id % 64) / 64e0 AS BIGINT) AS pixel", "(event_id * 7919) % 9000 + 1000 AS b03", "(event_id * 104729) % 9000 + 1000 AS b04", "(event_id * 1299709) % 9000 + 1000 AS b08",
    ]),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or a table as it is."""
    table, columns = VIEWS.get(name, (name, ["*"]))
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*columns)


def with_views(sql: str) -> str:
    """``sql`` with the views that it names before it."""
    used = [f"{name} AS (SELECT {', '.join(columns)} FROM {table})" for name, (table, columns) in VIEWS.items() if name in sql]
    body = sql.lstrip()
    more = body.startswith("+")  # the text goes on the list
    if not used and not more:
        return body
    return f"WITH {', '.join(used)}{',' if more and used else ''} {body.lstrip('+')}"
