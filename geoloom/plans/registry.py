"""Registered queries and their SQL: ``register`` puts a function over views on the list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.functions import geometry as G
from geoloom.plans.views import view, with_views

QUERIES, ORACLE = {}, {}


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def register(*views: str, sql: str):
    """A query over views; the function gets them as DataFrames. Doubles are rounded to six places."""

    def wrap(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(*(view(spark, sf_dir, v) for v in views)))
        ORACLE[f.__name__] = with_views(sql)
        return f

    return wrap


def r6(columns: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c.split('.')[-1]}" for c in columns.split())


def rint(e: str) -> str:
    return f"CAST(CASE WHEN {e} - floor({e}) < 5e-1 THEN floor({e}) ELSE ceil({e}) END AS BIGINT)"


def inside(f: G.Frame, x: str = "x", y: str = "y") -> str:
    return f"{x} >= {f.xmin} AND {x} <= {f.xmax} AND {y} >= {f.ymin} AND {y} <= {f.ymax}"
