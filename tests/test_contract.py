"""Every registered query against its SQL twin on the smallest data."""

import pytest

import __spark_entry__ as contract
from tests.compare import differences, oracle

FOLDER = "/root/testdata/sf0.001"
TWINS = contract.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle(FOLDER)


@pytest.mark.parametrize("name", sorted(TWINS))
def test_twin(spark, con, name):
    assert differences(contract.queries()[name](spark, FOLDER), con, TWINS[name]) is None


@pytest.mark.parametrize("name", sorted(set(contract.queries()) - set(TWINS)))
def test_rows(spark, name):
    assert contract.queries()[name](spark, FOLDER).count() > 0


def test_entry(spark):
    assert len(contract.entry(spark).columns) == 37
