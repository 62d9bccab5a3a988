"""Every registered query with SQL beside its DuckDB check on the given tables: a cross-section by default, all with ORACLE_ALL=1."""

import os
from pathlib import Path

import pytest

import __spark_entry__ as entry
from check_queries import compare, connect
from scenequarry.plans import pixels, streams

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
HEAVY = set(pixels.QUERIES) | set(streams.QUERIES)
LIGHT = [n for n in entry.oracle_sql() if n not in HEAVY]
NAMES = list(entry.oracle_sql()) if os.environ.get("ORACLE_ALL") else LIGHT[::5]

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    ok, note = compare(entry.queries()[name](spark, SF_DIR), con, entry.oracle_sql()[name])
    assert ok, note


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
