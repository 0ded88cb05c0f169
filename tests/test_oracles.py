"""Every registered query against its SQL on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from compare import differs, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, name):
    got = queries()[name](spark, SF).toPandas()
    assert len(got)
    if name in oracle_sql():
        assert differs(got, con.sql(oracle_sql()[name]).df()) is None


def test_entry(spark):
    assert entry(spark).count() == 1500


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())
