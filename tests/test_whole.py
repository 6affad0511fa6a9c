"""Operators over all of their input: no round, level or row is left out."""

from pyspark.sql import functions as F

from geoloom.operators import catalog, pointcloud, terrain
from geoloom.queries import QUERIES


def test_robust_fit_leaves_out_many(spark):
    good = [(float(i % 40), float(i // 40), 2.0 * (i % 40) + 5, 3.0 * (i // 40) - 7) for i in range(1600)]
    bad = [(float(k), 40.0 - k, 1000.0 * 1.4**k, -500.0 * 1.4**k) for k in range(23)]
    fit = catalog.robust_affinity(spark.createDataFrame(good + bad, "x double, y double, x2 double, y2 double")).first()
    assert fit["n"] == len(good) and fit["rms"] < 1e-9
    assert all(abs(a - b) < 1e-9 for a, b in zip(fit[:6], (2, 0, 5, 0, 3, -7), strict=True))


def test_rounds_of_a_fit_are_one_filter_on_a_table(spark, monkeypatch):
    plans, fit = [], terrain.affinity
    monkeypatch.setattr(catalog.terrain, "affinity", lambda pairs: plans.append(pairs._jdf.queryExecution().optimizedPlan().toString()) or fit(pairs))
    n = spark.range(1607).select(F.col("id").cast("double").alias("n"))
    x, y = F.col("n") % 40, F.floor(F.col("n") / 40)
    off = F.when(F.col("n") >= 1600, 1000 * F.pow(F.lit(1.4), F.col("n") - 1600)).otherwise(0)
    found = catalog.robust_affinity(n.select(x.alias("x"), y.cast("double").alias("y"), (2 * x + off).alias("x2"), (3 * y - off).alias("y2"))).first()
    assert found["n"] == 1600 and len(plans) >= 8
    assert all(p.count("Filter") <= 1 and p.count("Project") <= 1 and "Range" not in p for p in plans)


def test_holes_are_filled_up_to_the_extent(spark):
    known, size = spark.createDataFrame([(0, 0, 1.0), (3, 2, 3.0)], "u long, v long, z double"), spark.createDataFrame([(39, 20)], "mu long, mv long")
    got = {(r["u"], r["v"]): r["z"] for r in pointcloud.fill_holes(known, size=size).collect()}
    assert len(got) == 40 * 21 and got[1, 1] == 1 and got[39, 20] == 2 and None not in got.values()


def test_all_lines_are_sorted(spark):
    sf = "/root/testdata/sf0.001"
    rows = QUERIES["sort_size_all"](spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey").distinct().count() > 20
    assert all(a["size"] >= b["size"] for a, b in zip(rows, rows[1:], strict=False))


def test_nodes_are_dealt_out_before_they_are_sorted(spark):
    nodes = spark.createDataFrame([(0, 0, 1.0), (0, 1, 4.0), (1, 0, 2.0)], "row_ long, col long, z double")
    found = terrain.around(nodes, "east", "south")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.rindex("Exchange hashpartitioning(r") > plan.rindex("Aggregate")
    assert sorted(tuple(r) for r in found.collect()) == [(0, 0, 1.0, 4.0, 2.0), (0, 1, 4.0, None, None), (1, 0, 2.0, None, None)]
