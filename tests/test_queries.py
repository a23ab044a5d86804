"""Every registered query against its SQL oracle on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from oracle import compare, connect

SF_DIR = "/root/testdata/sf0.001"
NAMES = list(entry.queries())


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF_DIR)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
        return
    ok, note = compare(df, sql, con)
    assert ok, note
    assert "TYPES" not in note, note


def test_entry_has_a_stable_schema(spark):
    df = entry.entry(spark)
    assert df.columns == ["model", "dataset", "k_prefix", "u_circ", "u_bar", "r_hat"] and df.count() > 0
