"""Plans are lazy: building a registered query runs no job."""

import pytest

from laminaflow.plans import QUERIES

#: Building these works on data: streams are drained, models trained, tables written, and the median of all pairwise slopes looks for
#: series that are too long for one task.
AT_WORK = {n for n in QUERIES if n.startswith(("stream_", "risk_", "tail_"))} | {"live_tail", "snapshot_upsert", "signal_stats", "signal_trends", "maintenance_forecast",
                                                                                "theil_sen_all_pairs", "cross_session_summary"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - AT_WORK))
def test_building_runs_no_job(spark, name):
    tracker, group = spark.sparkContext.statusTracker(), f"build-{name}"
    spark.sparkContext.setJobGroup(group, name)
    try:
        QUERIES[name](spark, "/root/testdata/sf0.001")
        ran = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup(group)]
        names = [tracker.getStageInfo(s).name for j in ran if j for s in j.stageIds if tracker.getStageInfo(s)]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    # reading a file's schema is a job of the reader
    assert [n for n in names if not n.startswith(("parquet at", "text at", "load at"))] == []
