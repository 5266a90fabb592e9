"""Every registered query on the smallest tables, against its SQL where it has one."""

import pytest

import __spark_entry__ as entry
from tests.parity import compare, database

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return database(SF)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    problem = compare(spark, con, SF, name)
    assert problem in (None, "empty on both sides"), problem


def test_entry(spark):
    assert entry.entry(spark).count() > 0
