"""Every registered query against its SQL, and the contract with the driver."""

import __spark_entry__ as entry
import pytest
from conftest import SMALL
from testbed import oracle, queries
from testbed.compare import database, difference


@pytest.fixture(scope="module")
def con():
    return database(SMALL)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_same_as_sql(spark, con, name):
    assert difference(spark, con, SMALL, name) is None


def test_every_query_has_its_sql():
    assert set(queries.queries()) == set(oracle.oracle_sql())


def test_all_are_registered():
    assert set(queries.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
