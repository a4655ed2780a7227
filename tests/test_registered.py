"""Every registered query against its checking SQL, on the smallest data."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.compare import compare, connect

SF = "/root/testdata/sf0.001"
NAMES = sorted(queries())

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    sql = oracle_sql().get(name)
    if sql is None:
        assert queries()[name](spark, SF).count() > 0
        return
    problem, _ = compare(spark, con, SF, queries()[name], sql)
    assert problem is None, problem


def test_entry_has_rows(spark):
    df = entry(spark)
    assert df.count() > 0
    assert df.columns == ["meeting_id", "task_id", "task", "assignee", "deadline", "confidence"]


def test_checks_name_queries():
    assert set(oracle_sql()) <= set(queries())
