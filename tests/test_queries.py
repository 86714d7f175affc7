"""Every registered query against its SQL on the smallest data."""

import pytest
from compare import connect, differences

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
RUNS, SQLS = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_names():
    assert set(SQLS) <= set(RUNS)


@pytest.mark.parametrize("name", sorted(SQLS))
def test_same_as_sql(spark, con, name):
    assert differences(RUNS[name](spark, FOLDER), con, SQLS[name]) == []


@pytest.mark.parametrize("name", sorted(set(RUNS) - set(SQLS)))
def test_runs(spark, name):
    assert RUNS[name](spark, FOLDER).count() > 0


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 22
    assert all(r.tp + r.fp + r.tn + r.fn == 200 for r in rows)
