"""Reports that share one pass over the readings, and rows without a meter or a time."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from meterlake.catalog import QUERIES
from meterlake.operators import anomalies as H
from meterlake.operators import chartdata, features
from meterlake.operators import consumption as C
from meterlake.operators import profile as P
from meterlake.operators import segments as S
from meterlake.plans import reports as R
from meterlake.plans.ordered import join_stats, null_safe_join, sequential
from test_scale import fleet

CHUNKS = ["day", "hour", "minute", "week", "month", "none"]


def no_meter(spark, n=50):
    """50 readings, 10 of them without a meter and some without a time."""
    m = fleet(spark, n=n // 2, meters=2).withColumn("seq", F.col("seq") + F.col("meter_id") * 1000)
    return m.withColumn("meter_id", F.when(F.col("seq") % 5 != 3, F.col("meter_id"))) \
        .withColumn("voltage", 190.0 + F.col("seq") % 61).withColumn("ts", F.when(F.col("seq") % 11 != 7, F.col("ts")))


def close(a, b):
    return (a is None) == (b is None) and (a == b or isinstance(a, float) and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9))


def same(x, y, cols):
    rows = lambda d: sorted((tuple(r) for r in d.select(*cols).collect()), key=lambda r: tuple((v is not None, str(v)) for v in r[:2]))
    a, b = rows(x), rows(y)
    assert len(a) == len(b)
    for u, v in zip(a, b):
        assert all(close(p, q) for p, q in zip(u, v)), (u, v)


@pytest.fixture(params=CHUNKS)
def chunk(request, spark):
    spark.conf.set("meterlake.chunk", request.param)
    yield request.param
    spark.conf.unset("meterlake.chunk")


def test_rows_without_a_meter_stay(spark, chunk):
    m = no_meter(spark)
    assert S.power_steps(m).count() == 50
    kw = {"lag": ["active_power"], "cumsum": {"total": "seq"}, "row_number": "rn", "row_total": "all"}
    cols = ["meter_id", "seq", "prev_active_power", "total", "rn", "all"]
    same(sequential(m, **kw), sequential(m, chunk=None, **kw), cols)
    assert join_stats(m, H.voltage_stats(m)).count() == 50
    assert {r.meter_id: r.total_records for r in H.voltage_flags(m).collect()} == {0: 20, 1: 20, None: 10}
    assert {r.meter_id for r in H.power_step_anomalies(m).collect()} == {0, 1, None}
    assert {r.meter_id for r in H.high_power_threshold(m).collect()} == {0, 1, None}
    assert H.rolling_power(m).count() == 50
    assert features.feature_matrix(m).count() == 50
    assert {r.meter_id: r.bins for r in chartdata.voltage_histogram(m).groupBy("meter_id").agg(F.sum("count").alias("bins")).collect()} \
        == {0: 20, 1: 20, None: 10}
    assert {r.meter_id for r in H.alert_level(m).collect()} == {0, 1, None}


def test_summary_equals_the_detectors_one_by_one(spark, chunk):
    m = no_meter(spark, 400)
    one_by_one = null_safe_join(null_safe_join(H.voltage_flags(m), H.power_step_anomalies(m), "meter_id", "full"),
                                H.consumption_summary(m), "meter_id", "full")
    shared = H.anomaly_summary(m)
    assert set(shared.columns) == set(one_by_one.columns) - {"high_power_threshold"}
    same(shared, one_by_one, ["meter_id", *sorted(set(shared.columns) - {"meter_id"})])


def test_report_equals_its_parts(spark):
    m = no_meter(spark, 400)
    whole = R.consumption_report(m)
    for part in (C.daily_summary(m), C.peak_valley_hours(m), C.peak_valley_ratio(m), C.weekday_weekend(m), P.power_quality(m)):
        same(whole, part, ["meter_id", *[c for c in part.columns if c in whole.columns and c != "meter_id"]])


def test_constant_readings_have_no_spread(spark):
    m = no_meter(spark).withColumn("voltage", F.lit(220.1)).withColumn("active_power", F.lit(0.3))
    got = H.anomaly_summary(m).where("meter_id = 0").first()
    assert (got.voltage_std, got.power_std, got.sudden_count, got.spike_count) == (0.0, 0.0, 0, 0)


@pytest.mark.parametrize("name, scans", [("consumption_report", 1), ("consumption_report_text", 1), ("alert_level", 2), ("alerts_high", 2),
                                         ("anomaly_union", 2), ("analysis_json", 5), ("sequences", 2)])
def test_passes_over_the_readings(spark, name, scans):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("FileScan parquet") <= scans


def test_timeless_rows_of_a_meter_are_spread(spark):
    """90 % of one meter's rows have no time: several chunks hold them, with the same results."""
    from meterlake.plans import ordered
    m = spark.range(400_000).selectExpr(
        "0 AS meter_id", "id AS seq", "if(id % 10 = 0, timestampadd(MINUTE, cast(id AS int), timestamp_ntz'2024-01-01 00:00:00'), NULL) AS ts",
        "cast((id * 7919) % 3001 AS double) AS active_power")
    located = ordered.locate(m, ["meter_id"], ordered.ORDER, "day")
    cells = located.groupBy(*ordered.cell_columns(["meter_id"])).count().agg(F.max("count"), F.count("*")).first()
    assert cells[0] < 0.2 * 400_000 and cells[1] > 6
    kw = {"lag": ["active_power"], "cumsum": {"total": "seq"}, "row_number": "rn"}
    digest = lambda d: d.agg(F.sum(F.xxhash64("seq", "prev_active_power", "total", F.col("rn").cast("long")).cast("decimal(38,0)"))).first()[0]
    assert digest(sequential(m, chunk="day", **kw)) == digest(sequential(m, chunk=None, **kw))
