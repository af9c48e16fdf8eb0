"""Every registered query against its SQL, on the smallest tables."""

import os
import re

import pytest
from check_queries import compare, oracle

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="sample tables not found")


@pytest.fixture(scope="module")
def con():
    return oracle(FOLDER)


def test_names_agree():
    without = set(entry.queries()) - set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert all(re.match(r"op\d+_|pipeline$", name) for name in without), without


@pytest.mark.parametrize("name", list(entry.oracle_sql()))
def test_query(spark, con, name):
    problem = compare(spark, con, FOLDER, name)
    assert problem is None, problem


def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["o_orderkey", "l_partkey", "l_quantity"] and rows.count() > 0
