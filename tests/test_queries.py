"""Every registered query of the library proper against its reference SQL, over whole tables."""

import pytest
from compare import connect, differences

import __spark_entry__ as entry_module
from burstlens import plans

QUERIES = plans.queries()
ORACLES = plans.oracles()


@pytest.fixture(scope="module")
def con(request):
    return connect("/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf_dir, name):
    assert differences(QUERIES[name](spark, sf_dir), con, ORACLES[name]) == []


def test_entry(spark):
    assert entry_module.entry(spark).count() == 1500


def test_entry_registers_every_query():
    assert QUERIES.keys() <= entry_module.queries().keys()
    assert QUERIES.keys() == ORACLES.keys() <= entry_module.oracle_sql().keys()
