import pytest
from oracle import compare
from skyfold.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_against_its_sql(spark, name):
    compare(spark, queries.QUERIES[name], queries.ORACLES[name], "/root/testdata/sf0.001")
