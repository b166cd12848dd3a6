"""Every registered query against its DuckDB oracle on the smallest scale (SURVEY 5 (1))."""
import pytest

from lotline.plans.registry import load_all
from tools.oracle_check import check, duck

SF = "/root/testdata/sf0.001"
QUERIES = load_all()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    res = check(spark, con, name, QUERIES[name], SF)
    assert res[1] == "OK", res
