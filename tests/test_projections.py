"""Fixed points of the projections, and distances that a conformal map must keep."""

import pytest
from pyspark.sql import functions as F

from geoloom.functions import projections as P


def at(spark, lon, lat, to):
    x, y = to(F.lit(float(lon)), F.lit(float(lat)))
    return tuple(spark.range(1).select(x.alias("x"), y.alias("y")).first())


def test_origins(spark):
    assert at(spark, 3, 46.5, lambda a, b: P.conic(a, b, P.LAMBERT93)) == pytest.approx((700_000, 6_600_000), abs=1e-6)
    for lat in range(42, 51):
        assert at(spark, 3, lat, lambda a, b, p=P.conic_zone(lat): P.conic(a, b, p)) == pytest.approx((1_700_000, 200_000 + (lat - 41) * 1_000_000), abs=1e-6)
    assert at(spark, 3, 0, lambda a, b: P.utm(a, b, 31)) == pytest.approx((500_000, 0), abs=1e-6)
    assert at(spark, 3, 0, lambda a, b: P.utm(a, b, 31, south=True)) == pytest.approx((500_000, 10_000_000), abs=1e-6)


def test_paris(spark):
    """The city's usual coordinates, to a metre."""
    assert at(spark, 2.3522, 48.8566, lambda a, b: P.conic(a, b, P.LAMBERT93)) == pytest.approx((652_469, 6_862_035), abs=1)
    assert at(spark, 2.3522, 48.8566, lambda a, b: P.utm(a, b, 31)) == pytest.approx((452_484, 5_411_718), abs=2)


def test_meridian_arc(spark):
    """The quarter meridian of the ellipsoid is 10,001,965.729 m."""
    _, y = at(spark, 3, 90 - 1e-9, lambda a, b: P.utm(a, b, 31))
    assert y / P.SCALE == pytest.approx(10_001_965.729, abs=0.01)
