"""Every registered query against its DuckDB oracle (the driver's check).

Runs at sf0.001 by default; PLAYLENS_ORACLE_SF=0.01 runs the driver's size.
"""

import os

import pytest

import __spark_entry__ as entry
from oracle_check import compare, duck
from playlens.registry import QUERIES

SF_DIR = f"/root/testdata/sf{os.environ.get('PLAYLENS_ORACLE_SF', '0.001')}"
KEYS = sorted(QUERIES)


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_every_query_has_an_oracle():
    assert set(KEYS) <= set(entry.queries())
    assert set(KEYS) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["level", "total_attempts", "unique_users", "avg_playtime", "success_rate",
                          "dropoff_rate", "fail_rate", "avg_attempts"]
    assert df.count() > 0


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, con, key):
    res, _ = compare(entry.queries()[key](spark, SF_DIR), con, entry.oracle_sql()[key])
    assert res["ok"], res
