"""The two-level (chunked) plans must equal the plain per-meter windows."""
import random

from pyspark.sql import functions as F

from conftest import readings
from meterlake.operators import anomalies as H
from meterlake.operators import consumption as C
from meterlake.operators import segments as S
from meterlake.plans.ordered import rolling, sequential


def fleet(spark, n=400, meters=3, seed=7):
    """Irregular gaps spanning several days, repeated timestamps (seq breaks
    ties) and missing power values."""
    import datetime as dt
    rnd = random.Random(seed)
    base = dt.datetime(2024, 3, 1)
    data = []
    for m in range(meters):
        t = 0
        for i in range(n):
            t += rnd.choice([0, 7, 60, 600, 1400])
            p = None if i % 23 == 5 else round(rnd.uniform(0, 2500), 2)
            data.append({"meter_id": m, "seq": i, "ts": base + dt.timedelta(minutes=t), "active_power": p})
    return readings(spark, data)


def collect(df, key=("meter_id", "seq")):
    return sorted(tuple(r) for r in df.orderBy(*key).collect())


def test_lag_rownumber_cumsum_equal_plain(spark):
    m = fleet(spark).withColumn("one", F.lit(1))
    kw = dict(lag=["active_power"], cumsum={"n_seen": "one"}, row_number="rn")
    plain = sequential(m, chunk=None, **kw).select("meter_id", "seq", "prev_active_power", "n_seen", "rn")
    for unit in ("day", "hour"):
        chunked = sequential(m, chunk=unit, **kw).select("meter_id", "seq", "prev_active_power", "n_seen", "rn")
        assert collect(chunked) == collect(plain)


def test_rows_without_a_time_are_kept(spark):
    """NULL times sort first, in the chunked plan as in the plain one."""
    df = fleet(spark, n=60, meters=2).withColumn("ts", F.when(F.col("seq") % 5 != 0, F.col("ts")))
    kw = {"lag": ["active_power"], "cumsum": {"total": "seq"}, "row_number": "rn"}
    chunked, plain = (sequential(df, chunk=c, **kw) for c in ("day", None))
    assert chunked.count() == 120
    assert collect(chunked) == collect(plain)


def test_rolling_blocks_equal_plain(spark):
    m = fleet(spark, n=120)
    aggs = {"s": ("sum", "active_power"), "c": ("count", "active_power")}
    plain = rolling(m, aggs, 5, chunk=None).select("meter_id", "seq", F.round("s", 6), "c")
    small = rolling(m, aggs, 5, chunk="day", block=7).select("meter_id", "seq", F.round("s", 6), "c")
    assert collect(small) == collect(plain)


def test_rolling_power_chunked_equals_plain_bit_for_bit(spark):
    m = fleet(spark, n=150)
    a = H.rolling_power(m, chunk=None).select("meter_id", "seq", "rolling_mean", "rolling_std")
    b = H.rolling_power(m, chunk="day", block=64).select("meter_id", "seq", "rolling_mean", "rolling_std")
    assert collect(a) == collect(b)


def test_segments_chunked_equal_plain(spark):
    m = fleet(spark)
    a = S.segments(m, 50.0, chunk=None)
    b = S.segments(m, 50.0, chunk="hour")
    assert collect(a, ("meter_id", "segment_id")) == collect(b, ("meter_id", "segment_id"))


def test_fleet_equals_union_of_single_meters(spark):
    m = fleet(spark)
    whole = collect(C.daily_summary(m), ("meter_id",))
    parts = []
    for k in range(3):
        parts += collect(C.daily_summary(m.where(F.col("meter_id") == k)), ("meter_id",))
    assert whole == sorted(parts)
    whole_a = collect(H.alert_level(m), ("meter_id",))
    parts_a = []
    for k in range(3):
        parts_a += collect(H.alert_level(m.where(F.col("meter_id") == k)), ("meter_id",))
    assert whole_a == sorted(parts_a)


def test_exact_quantile_equals_spark_percentile(spark):
    from meterlake.plans.quantiles import exact_quantile
    rnd = random.Random(11)
    rows = []
    for k, n in enumerate([1, 2, 3, 40, 900]):
        for _ in range(n):
            rows.append((k, rnd.choice([rnd.uniform(-50, 3000), 5.0, round(rnd.uniform(0, 10), 2)])))
    df = spark.createDataFrame(rows, "k long, v double")
    for q in (0.0, 0.2, 0.8, 0.95, 1.0):
        want = {r.k: r.p for r in df.groupBy("k").agg(F.percentile("v", q).alias("p")).collect()}
        for buckets, rounds in ((4096, 2), (2, 4), (5, 1)):
            got = {r.k: r.quantile for r in exact_quantile(df, "k", "v", q, buckets=buckets, rounds=rounds).collect()}
            assert got == want


def test_hot_meter_is_spread_over_tasks(spark):
    """One meter holds most rows: the plain per-meter window puts all of them in
    one task, the chunked plan spreads them over (meter, day) partitions."""
    import datetime as dt
    base = dt.datetime(2024, 3, 1)
    data = [{"meter_id": 0, "seq": i, "ts": base + dt.timedelta(minutes=20 * i), "active_power": float(i % 97)}
            for i in range(3000)]
    data += [{"meter_id": k, "seq": i, "ts": base + dt.timedelta(minutes=60 * i), "active_power": 1.0}
             for k in (1, 2) for i in range(100)]
    m = readings(spark, data)
    # emulate large inputs: no partition coalescing, and no broadcast of the
    # (here tiny) readings side, which would hand the output the carry side's layout
    keys = ["spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.autoBroadcastJoinThreshold",
            "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    old = {k: spark.conf.get(k, None) for k in keys}
    spark.conf.set(keys[0], "false")
    spark.conf.set(keys[1], "-1")
    spark.conf.set(keys[2], "-1")
    try:
        def biggest(df):
            # aggregate the lag column too, so the window is not pruned away
            sizes = (df.groupBy(F.spark_partition_id().alias("p"))
                     .agg(F.count(F.lit(1)).alias("n"), F.max("prev_active_power").alias("x")).collect())
            return max(r["n"] for r in sizes)
        plain = biggest(sequential(m, lag=["active_power"], chunk=None))
        chunked = biggest(sequential(m, lag=["active_power"], chunk="day"))
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    assert plain >= 3000
    assert chunked < plain / 2


def test_chunk_unit_from_session_setting(spark):
    from meterlake.plans.ordered import resolve_chunk
    m = fleet(spark, n=20)
    assert resolve_chunk(m, "auto") == "day" and resolve_chunk(m, None) is None
    spark.conf.set("meterlake.chunk", "hour")
    try:
        assert resolve_chunk(m, "auto") == "hour"
        spark.conf.set("meterlake.chunk", "none")
        assert resolve_chunk(m, "auto") is None
        a = collect(S.segments(m, 50.0).select("meter_id", "segment_id", "duration_minutes"), ("meter_id", "segment_id"))
    finally:
        spark.conf.unset("meterlake.chunk")
    b = collect(S.segments(m, 50.0).select("meter_id", "segment_id", "duration_minutes"), ("meter_id", "segment_id"))
    assert a == b


def test_rolling_block_equal_to_frame_tail(spark):
    """block = n - 1: every row of a block is copied into the next one."""
    m = fleet(spark, n=60)
    aggs = {"c": ("count", "active_power"), "mx": ("max", "active_power")}
    plain = rolling(m, aggs, 5, chunk=None).select("meter_id", "seq", "c", "mx")
    edge = rolling(m, aggs, 5, chunk="day", block=4).select("meter_id", "seq", "c", "mx")
    assert collect(edge) == collect(plain)
