"""Every query with an SQL form equals it on the smallest tables; the others return rows."""

import pytest

import __spark_entry__ as driver
from tests.compare import duck, frames_differ

SF_DIR = "/root/testdata/sf0.001"
SQL = driver.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("key", sorted(SQL))
def test_matches_sql(spark, con, key):
    got = driver.queries()[key](spark, SF_DIR).toPandas()
    assert frames_differ(got, con.execute(SQL[key]).df()) == ""


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(driver.queries())


def test_entry(spark):
    assert driver.entry(spark).count() > 0
