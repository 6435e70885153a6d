import pytest
from folioflow.plans import queries as plans

from oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_matches_sql(spark, con, name):
    compare(spark, con, plans.queries()[name], plans.oracle_sql()[name], SF)


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_has_rows(spark, name):
    assert plans.queries()[name](spark, SF).limit(1).count() == 1
