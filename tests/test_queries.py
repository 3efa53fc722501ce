"""Every registered query against its DuckDB twin on the smallest sample."""

from pathlib import Path

import pytest

import __spark_entry__ as contract
from check import connect, difference
from sealtrail.plans.catalog import ALL

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="sample tables not present")


@pytest.fixture(scope="module")
def db():
    return connect(SF)


def test_every_query_has_a_twin():
    assert set(ALL) <= set(contract.queries())
    assert set(ALL) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(ALL))
def test_query(spark, db, name):
    assert difference(spark, db, name, SF) is None


def test_entry(spark):
    assert contract.entry(spark).first()["status"] == "ok"
