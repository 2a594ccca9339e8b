"""Every registered query against its SQL, and the driver contract."""

import pytest
from oracle import connect, differences

import __spark_entry__ as contract
from newsloom.catalog import ORACLE, QUERIES

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def connection():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLE.keys()
    assert contract.queries().items() >= QUERIES.items()


@pytest.mark.parametrize("name", contract.oracle_sql())
def test_query_matches_sql(spark, connection, name):
    result = contract.queries()[name](spark, SF_DIR)
    assert differences(result, connection, contract.oracle_sql()[name]) is None


def test_entry(spark):
    result = contract.entry(spark)
    assert result.columns == ["rank", "category", "n", "share", "share_text"]
    assert result.count() > 0
