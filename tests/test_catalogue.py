import pytest
from oracle import assert_same

from corpusmill.plans import catalogue

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_as_sql(spark, name):
    assert_same(spark, catalogue.queries()[name], catalogue.oracle_sql()[name], FOLDER)
