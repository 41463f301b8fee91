import pytest
from oracle import compare
from skyfold.plans.catalog import ORACLES, QUERIES


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_against_its_sql(spark, name):
    compare(spark, QUERIES[name], ORACLES[name], "/root/testdata/sf0.01")
