"""Each registered core query against its SQL in DuckDB, over the smallest tables."""

import pytest

from cohortry.plans import queries as Q
from differential import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, con, name):
    assert compare(spark, con, SF, Q.QUERIES[name], Q.ORACLES[name]) is None

