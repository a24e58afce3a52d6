"""Every registered query against its SQL, on the small tables.

TRACEFLOW_SF names another scale, such as 0.01.
"""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tools.compare import compare, connect

SF = f"/root/testdata/sf{os.environ.get('TRACEFLOW_SF', '0.001')}"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, name):
    df = queries()[name](spark, SF)
    sql = oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
    else:
        assert compare(df, con, sql) == ""


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() > 0
