"""Every registered query runs, and gives the rows of its SQL equivalent."""

import pytest
from compare import difference, duck_bag, oracle, spark_bag
from conftest import SF_DIR

import __spark_entry__ as app


@pytest.fixture(scope="module")
def con():
    return oracle(SF_DIR)


@pytest.mark.parametrize("name", list(app.queries()))
def test_query(spark, con, name):
    got = spark_bag(app.queries()[name](spark, SF_DIR))
    sql = app.oracle_sql().get(name)
    if sql is not None:
        assert difference(got, duck_bag(con, sql)) is None
    else:
        assert got[1]


def test_entry(spark):
    assert app.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(app.oracle_sql()) <= set(app.queries())
