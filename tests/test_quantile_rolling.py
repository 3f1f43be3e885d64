"""Exact quantiles under outliers and rolling frames by halo."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from meterlake.operators import anomalies as H
from meterlake.plans import quantiles
from meterlake.plans.ordered import rolling
from test_scale import collect, fleet


@pytest.mark.parametrize("q", [0.0, 0.5, 0.95, 1.0])
def test_outliers_leave_few_candidates(spark, monkeypatch, q):
    """1e12 and 1e8 among ordinary readings: the result is Spark's percentile, and the first
    counting round leaves a small share of the distinct values."""
    df = spark.range(200_000).selectExpr("id % 2 AS k", """CASE WHEN id < 4 THEN 1e12 WHEN id < 40 THEN 1e8 WHEN id < 60 THEN -1e12
        ELSE cast((id * 7919) % 199999 AS double) / 64 END AS v""")
    want = {r.k: r.p for r in df.groupBy("k").agg(F.percentile("v", q).alias("p")).collect()}
    for rounds in (1, 2):
        got = {r.k: r.quantile for r in quantiles.exact_quantile(df, "k", "v", q, rounds=rounds).collect()}
        assert got == want
    left = []
    real = quantiles.null_safe_join

    def counting(rows, state, keys):
        out = real(rows, state, keys)
        left.append(out.where((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi"))))
        return out
    monkeypatch.setattr(quantiles, "null_safe_join", counting)
    quantiles.exact_quantile(df, "k", "v", q, rounds=1)
    sizes = [r["count"] for r in left[-1].groupBy("k").count().collect()]
    assert max(sizes) <= 100_000 * 4 * quantiles.PIVOT_STEP


def test_ties_at_the_pivots(spark):
    df = spark.range(5000).selectExpr("1 AS k", "cast(if(id < 4900, 7, id) AS double) AS v")
    for q in (0.1, 0.95, 0.98, 0.981):
        want = df.agg(F.percentile("v", q)).first()[0]
        assert [r.quantile for r in quantiles.exact_quantile(df, "k", "v", q).collect()] == [want]


@pytest.mark.parametrize("unit", ["day", "hour", "minute", "month"])
@pytest.mark.parametrize("n", [1, 2, 5, 60])
def test_halo_equals_the_plain_window(spark, unit, n):
    """Chunks shorter than the frame, tied and missing times, bit for bit."""
    m = fleet(spark, n=150, meters=2).withColumn("ts", F.when(F.col("seq") % 13 != 4, F.col("ts")))
    cols = ["meter_id", "seq", "rolling_mean", "rolling_std"]
    assert collect(H.rolling_power(m, n, chunk=unit).select(cols)) == collect(H.rolling_power(m, n, chunk=None).select(cols))


def test_readings_are_shuffled_once(spark):
    """One exchange carries all readings; the other ones carry tails that are limited before them."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = H.rolling_power(fleet(spark, n=30))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("WindowGroupLimit") >= 2
    assert plan.count("Exchange hashpartitioning") <= 3


def test_other_aggregates(spark):
    m = fleet(spark, n=80, meters=1)
    aggs = {"lo": ("min", "active_power"), "c": ("count", "voltage")}
    a, b = (rolling(m, aggs, 7, chunk=c).select("meter_id", "seq", "lo", "c") for c in ("hour", None))
    assert collect(a) == collect(b)
