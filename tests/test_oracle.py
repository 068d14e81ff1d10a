"""Every query against its SQL on the smallest tables."""

import compare
import pytest
from conftest import SF

import __spark_entry__ as contract
from haulcomp.catalog import QUERIES


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF)



def test_every_query_has_sql():
    assert set(QUERIES) <= set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, con, name):
    problem = compare.check(spark, con, name, SF)
    # The smallest tables have no outliers to list.
    assert problem is None or (problem == "no rows" and name == "d8_box_outliers"), problem
