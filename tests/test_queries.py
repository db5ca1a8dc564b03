"""Every registered query with SQL text against DuckDB on the smallest tables."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
import tools_check

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return tools_check.duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    _, rows, verdict = tools_check.run(spark, con, name, SF, QUERIES, ORACLES)
    assert verdict in ("ok", "no-sql"), f"{name} ({rows} rows): {verdict}"


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["trace_id", "p0", "p1", "p50", "p99"]
    assert df.count() > 0
