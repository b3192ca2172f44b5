"""Every registered query against its oracle on the smallest shared tables."""

import os

import pytest

import __spark_entry__ as driver
from tests import oracle
from usagelake.plans import registry

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="shared tables are not here")
NAMES = sorted(registry.QUERIES)


@pytest.fixture(scope="module")
def connection():
    return oracle.connect(SF_DIR)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, connection, name):
    rows, _, message = oracle.compare(
        spark, connection, name, driver.queries()[name], driver.oracle_sql().get(name), SF_DIR)
    assert not message
    assert rows >= 0


def test_entry(spark):
    if os.path.isdir(driver.SMOKE_DIR):
        assert driver.entry(spark).count() > 0


def test_every_query_has_an_oracle():
    assert set(registry.QUERIES) == set(registry.ORACLES)
