"""A cross-section of the registered queries against their SQL; tests/check.py runs all of them."""

import os

import oracle
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
PICKED = ["signal_stats", "robust_spike", "gap_sessions", "state_transitions", "before_after_events", "data_quality", "interval_link", "context_at_start",
          "query_group", "tolerance_violations", "calibration_factors", "platform_rollup", "parse_event_lines", "stream_sessions"]


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    return oracle.connect(SF)


@pytest.mark.parametrize("name", PICKED)
def test_query_matches_sql(spark, con, name):
    ok, msg = oracle.compare(spark, con, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert ok, msg


def test_entry_and_registry(spark):
    df = entry.entry(spark)
    assert df.columns[:2] == ["session_id", "signal"] and df.count() >= 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
