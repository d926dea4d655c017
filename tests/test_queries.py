"""Every registered query against its SQL on the smallest tables."""

import os

import pytest
from compare import check, duck

from duologue.plans.registry import load_all

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are missing")
QUERIES = load_all()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    status, rows, _, note = check(spark, con, name, QUERIES[name], SF)
    assert status in ("ok", "rows-only"), f"{name}: {status} {note}"
    assert rows > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
