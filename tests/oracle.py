"""Runs a query's SQL in DuckDB and holds it against Spark's rows."""

import glob
import math
import os

import duckdb


def duck(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: round(float(v), 5) + 0.0 if isinstance(v, float) else v
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def same(df, sql, sf_dir) -> str:
    """Empty if Spark's rows are DuckDB's, else the difference."""
    found = duck(sf_dir).execute(sql)
    names = [c[0] for c in found.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    a, b = rows_of(df.columns, df.collect()), rows_of(names, found.fetchall())
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    near = lambda x, y: x == y or isinstance(x, (int, float)) and isinstance(y, (int, float)) and math.isclose(x, y, rel_tol=1e-9, abs_tol=2e-5)
    return next((f"{x} and {y}" for x, y in zip(a, b, strict=True) if not all(map(near, x, y))), "")
