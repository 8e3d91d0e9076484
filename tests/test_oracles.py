"""Every registered query beside its SQL, on the smallest data set."""

import pytest

import __spark_entry__ as entry
import check
from mostrador import plans

FOLDER = "/root/testdata/sf0.001"
# The text operators have tests of their own.
KEYS = sorted(plans.queries())


@pytest.fixture(scope="module")
def con():
    return check.connect(FOLDER)


def test_every_query_has_sql():
    assert set(KEYS) == set(plans.oracle_sql()) and set(KEYS) <= set(entry.queries())


@pytest.mark.parametrize("key", KEYS)
def test_matches_sql(spark, con, key):
    ok, message, _, _ = check.compare(spark, con, key, FOLDER)
    assert ok, message


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
