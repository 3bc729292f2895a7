"""Every query that has an SQL counterpart gives the same rows."""

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, duck

SF_DIR = "/root/testdata/sf0.01"
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, con, name):
    assert compare(entry.queries()[name](spark, SF_DIR), con, ORACLES[name]) is None


def test_entry(spark):
    df = entry.entry(spark)
    assert "severity" in df.columns and df.count() == 1000


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(entry.queries())


def test_session_zone_does_not_matter(spark, con):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        for name in ("event_times", "probe_json_ingest", "alerts", "stream_activity"):
            assert compare(entry.queries()[name](spark, SF_DIR), con, ORACLES[name]) is None, name
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
