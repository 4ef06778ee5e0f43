"""Every registered query against its DuckDB counterpart."""

import os

import pytest

import __spark_entry__ as registered
from tests.compare import connect, differences

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_same_names():
    assert set(registered.oracle_sql()) <= set(registered.queries())
    without = set(registered.queries()) - set(registered.oracle_sql())
    assert all(name == "pipeline" or name.startswith("op") for name in without)


@pytest.mark.parametrize("name", list(registered.queries()))
def test_query(spark, duck, name):
    rows = registered.queries()[name](spark, SF_DIR).toPandas()
    assert len(rows) > 0 or name == "sample_every_n"
    if name in registered.oracle_sql():
        assert differences(rows, duck.execute(registered.oracle_sql()[name]).df()) == ""


def test_entry(spark):
    assert registered.entry(spark).count() == 164
