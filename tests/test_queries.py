import pytest

from geoloom.queries import ORACLE, QUERIES
from tests.oracle import same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_as_sql(spark, name):
    assert same(QUERIES[name](spark, SF), ORACLE[name], SF) == ""
