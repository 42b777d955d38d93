"""Every registered query against its SQL."""

import pytest

import __spark_entry__ as entry
from compare import connect, difference
from tributary.plans import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", [q.__name__ for q in queries.QUERIES])
def test_query(spark, con, name):
    got = entry.queries()[name](spark, SF).toPandas()
    want = con.execute(entry.oracle_sql()[name]).df()
    assert difference(got, want) is None
    assert len(got) or name in ("binary_rule",)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
