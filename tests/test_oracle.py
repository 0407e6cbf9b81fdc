"""Every registered query against its oracle SQL on the smallest data."""

import pytest

import __spark_entry__ as registered
from marketlens_checks.compare import compare, oracle


@pytest.fixture(scope="module")
def connection(sf_dir):
    return oracle(sf_dir)


@pytest.mark.parametrize("name", list(registered.queries()))
def test_query(spark, connection, sf_dir, name):
    difference, _, _, _ = compare(spark, connection, sf_dir, name)
    assert difference is None


def test_every_oracle_has_a_query():
    assert set(registered.oracle_sql()) <= set(registered.queries())


def test_entry(spark):
    assert registered.entry(spark).count() == 7
