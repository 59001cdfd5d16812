"""Every registered query against its SQL on the smallest tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as entry  # noqa: E402
from tools.check import compare, oracle_connection  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle_connection(SF)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    ok, n, note = compare(spark, con, SF, name, entry.queries()[name], entry.oracle_sql().get(name))
    assert ok, note
    assert n > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
