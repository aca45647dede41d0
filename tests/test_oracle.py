"""Every registered query against its SQL twin on the smallest data."""

import pytest

import __spark_entry__ as entry
from oracle import compare, duck

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    verdict = compare(spark, con, FOLDER, name, entry.queries()[name], entry.oracle_sql().get(name))[0]
    assert verdict in ("ok", "rows only")


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["px", "py", "density"] and df.count() > 0


def test_oracle_keys():
    assert set(entry.oracle_sql()) <= set(entry.queries())
