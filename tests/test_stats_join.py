"""Statistics joined back to readings: no task per meter, same rows as the plain join."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from meterlake.operators import anomalies as H
from meterlake.operators import chartdata as K
from meterlake.plans.ordered import join_stats


@pytest.fixture
def plain_joins(spark):
    """Sort-merge joins with fixed partitions, as at a size where nothing is broadcast."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    old = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def _fleet(spark, n=60_000):
    """95 % of the rows in meter 0, one in fifty without a time."""
    return spark.range(n).selectExpr(
        "if(id % 20 = 0, 1 + id % 3, 0) AS meter_id", "id AS seq",
        "if(id % 50 = 7, NULL, timestampadd(MINUTE, cast(id * 7 AS int), timestamp_ntz'2024-01-01 00:00:00')) AS ts",
        "210 + (id * 37) % 41 AS voltage", "cast((id * 7919) % 3001 AS double) AS active_power")


def test_a_hot_meter_is_spread_over_tasks(spark, plain_joins):
    m = _fleet(spark).where("ts is not null")
    x = join_stats(m, H.voltage_stats(m))
    sizes = [r["count"] for r in x.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == m.count() and max(sizes) < 0.3 * sum(sizes)


@pytest.mark.parametrize("op", [H.voltage_flags, H.voltage_outliers, H.high_power_threshold, H.power_step_anomalies,
                                K.voltage_histogram])
def test_readings_meet_statistics_by_chunk(spark, plain_joins, op):
    """Readings meet the statistics on (meter, chunk)."""
    plan = op(_fleet(spark))._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "SortMergeJoin" in line]
    assert any("_chunk" in line for line in joins)


@pytest.mark.parametrize("chunk", ["day", "hour"])
def test_same_result_as_the_plain_join(spark, chunk):
    m = _fleet(spark, 5000)
    s = H.voltage_stats(m)
    cols = ["meter_id", "seq", "n", "v_mean"]
    a = {tuple(r) for r in join_stats(m, s, chunk=chunk).select(cols).collect()}
    b = {tuple(r) for r in join_stats(m, s, chunk=None).select(cols).collect()}
    assert a == b and len(a) == 5000
