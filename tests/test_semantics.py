"""Hand-made frames for the semantic traps of the reference."""
import math

import numpy as np
from pyspark.sql import functions as F

from conftest import readings
from meterlake.functions.numeric import clean_nan, r
from meterlake.operators import anomalies as H
from meterlake.operators import appliances as A
from meterlake.operators import chartdata as K
from meterlake.operators import consumption as C
from meterlake.operators import efficiency as E
from meterlake.operators import profile as P
from meterlake.operators import segments as S


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_rounding_is_numpy_half_even(spark):
    vals = [0.125, 0.135, 2.675, 10.254999999999999, -0.001, 1.005, 123.455, 0.5, 1.5, 2.5]
    got = spark.createDataFrame([(v,) for v in vals], "x double").select(r("x", 2).alias("y")).collect()
    assert [g.y for g in got] == [float(np.round(v, 2)) for v in vals]
    assert got[0].y == 0.12


def test_nan_and_inf_become_null(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (None,)], "x double")
    assert [x.x for x in clean_nan(df).collect()] == [1.0, None, None, None]


def test_daily_ties_pick_earliest_date_and_empty_energy_sums_to_zero(spark):
    m = readings(spark, [{"energy": 0.5}, {"energy": 0.5}, {"energy": 0.2}, {"energy": None}],
                 step_minutes=1440)
    s = one(C.daily_summary(m))
    assert str(s.max_day) == "2024-03-15" and str(s.min_day) == "2024-03-18"
    assert s.min_daily_energy == 0.0 and s.total_days == 4
    d = {str(x.date): x.total_energy for x in C.daily_stats(m).collect()}
    assert d["2024-03-18"] == 0.0


def test_weekday_is_monday_zero_and_zero_weekday_gives_null_percent(spark):
    # 2024-03-15 is a Friday, 2024-03-16 a Saturday
    m = readings(spark, [{"energy": 0.0}, {"energy": 1.0}], step_minutes=1440)
    w = {x.weekday: x.day for x in C.weekday_breakdown(m).collect()}
    assert w == {4: "Fri", 5: "Sat"}
    ww = one(C.weekday_weekend(m))
    assert ww.weekday_avg == 0.0 and ww.weekend_avg == 1.0 and ww.difference_percent is None


def test_segments_gaps_and_islands(spark):
    m = readings(spark, [100.0, 100.0, 200.0, 210.0, 100.0])
    segs = sorted(S.segments(m, 50.0).collect(), key=lambda x: x.segment_id)
    assert [(s.segment_id, s.duration_minutes, s.avg_power, s.power_change) for s in segs] == [
        (0, 2, 100.0, 0.0), (1, 2, 205.0, 100.0), (2, 1, 100.0, 110.0)]
    lone = one(S.segments(readings(spark, [100.0]), 50.0))
    assert lone.power_change is None and lone.duration_minutes == 1


def test_segments_threshold_is_strict(spark):
    segs = S.segments(readings(spark, [100.0, 150.0, 200.01]), 50.0).collect()
    assert len(segs) == 2


def _matches(spark, power):
    req = spark.createDataFrame([(float(power),)], "power double")
    return [(x.appliance, x.confidence) for x in
            sorted(A.match_by_power(req).collect(), key=lambda x: x.rank)]


def test_match_by_power_goldens(spark):
    assert _matches(spark, 150) == [("refrigerator", 83.3), ("lighting", 81.8), ("tv", 76.5)]
    assert _matches(spark, 1200) == [("microwave", 76.0), ("air_conditioner", 73.3), ("electric_heater", 68.0)]
    assert _matches(spark, 50) == [("lighting", 63.6)]
    # tie at 60.0: catalogue order (refrigerator before tv)
    assert _matches(spark, 80) == [("lighting", 69.1), ("refrigerator", 60.0), ("tv", 60.0)]
    assert _matches(spark, 5000) == []


def test_match_by_segment_scores(spark):
    seg = spark.createDataFrame([(1, 0, 150.0, 30, 120.0)],
                                "meter_id long, segment_id long, avg_power double, duration_minutes long, "
                                "power_change double")
    got = [(x.appliance, x.confidence) for x in sorted(A.match_by_segment(seg).collect(), key=lambda x: x.rank)]
    assert got == [("lighting", 90), ("refrigerator", 60), ("tv", 60)]


def test_usage_buckets_half_open_and_zero_filled(spark):
    m = readings(spark, [0.0, 99.99, 100.0, 300.0, 799.0, 800.0, 1500.0, 2999.0, 3000.0, -5.0, None])
    got = {x.category: (x["count"], x.percentage) for x in A.usage_distribution(m).collect()}
    assert got == {"standby": (2, 18.18), "small": (1, 9.09), "medium": (2, 18.18),
                   "large": (1, 9.09), "high_power": (2, 18.18)}
    empty = {x.category: x["count"] for x in A.usage_distribution(readings(spark, [50.0])).collect()}
    assert empty["high_power"] == 0 and len(empty) == 5


def test_top_hours_ties_keep_lower_hour(spark):
    m = readings(spark, [100.0] * 6, step_minutes=60)
    top = [(x.kind, x.rank, x.hour) for x in A.top_hours(m, 5).collect() if x.kind == "peak"]
    assert sorted(top) == [("peak", i + 1, i) for i in range(5)]


def test_voltage_limits_are_inclusive_and_sag_needs_high_mean(spark):
    m = readings(spark, [{"voltage": v} for v in [198.0, 242.0, 197.99, 242.01]])
    v = one(H.voltage_flags(m))
    assert (v.out_of_range_count, v.low_count, v.high_count) == (2, 1, 1)
    # mean 230: 0.9 * mean = 207 -> 200 V is a sag (>= 198); nothing can swell above 242
    m2 = readings(spark, [{"voltage": x} for x in [200.0, 240.0, 240.0, 240.0]])
    v2 = one(H.voltage_flags(m2))
    assert v2.sag_count == 1 and v2.swell_count == 0


def test_zscore_needs_six_days(spark):
    five = readings(spark, [{"energy": float(e)} for e in [1, 1, 1, 1, 10]], step_minutes=1440)
    assert H.daily_zscore(five).count() == 0
    six = readings(spark, [{"energy": float(e)} for e in [1, 1, 1, 1, 1, 10]], step_minutes=1440)
    z = one(H.daily_zscore(six))
    assert z.deviation == "high" and math.isclose(z.z_score, 2.24)
    s = one(H.consumption_summary(six))
    assert s.abnormal_days == 1 and s.consumption_status == "normal"


def test_clean_meter_has_alert_level_none(spark):
    m = readings(spark, [100.0] * 10)
    a = one(H.alert_level(m))
    assert a.alert_level == "none" and a.total_anomalies == 0 and a.recommended_actions == ""
    assert a.voltage_status == "normal"


def test_spike_gives_high_alert(spark):
    m = readings(spark, [100.0] * 30 + [3000.0] + [100.0] * 30)
    a = one(H.alert_level(m))
    assert a.alert_level == "high" and a.high_priority == 1
    types = {x.type for x in H.anomaly_union(m).collect()}
    assert {"power_spike", "power_drop", "sudden_power_change"} <= types


def test_overall_score_clamps_and_zero_without_base_load(spark):
    hi = one(E.overall_efficiency(readings(spark, [50.0, 500.0, 600.0])))
    assert hi.overall_score == 100.0 and hi.efficiency_level == "excellent" and hi.raw_score > 100
    no_base = one(E.overall_efficiency(readings(spark, [500.0, 600.0, 700.0])))
    assert no_base.overall_score == 0.0 and no_base.efficiency_level == "poor" and no_base.base_load == 0.0
    cal = one(E.overall_efficiency(readings(spark, [50.0, 500.0, 600.0]), calibrated=True))
    assert 0 < cal.overall_score < 100


def test_appliance_efficiency_levels_and_not_running(spark):
    m = readings(spark, [1000.0] * 120)
    got = {x.appliance: x for x in E.appliance_efficiency(m).collect()}
    ac = got["air_conditioner"]
    assert (ac.status, ac.efficiency_level, ac.efficiency_score, ac.operating_hours) == ("running", "excellent", 95, 2.0)
    assert got["refrigerator"].status == "not_running" and got["refrigerator"].efficiency_level is None


def test_period_score_uses_rounded_values(spark):
    # pf 0.896 rounds to 0.90: no penalty
    m = readings(spark, [{"active_power": 100.0, "power_factor": 0.896}] * 3, start="2024-03-15 08:00:00")
    p = one(E.period_efficiency(m))
    assert p.period == "morning" and p.efficiency_score == 100.0
    m2 = readings(spark, [{"active_power": 100.0, "power_factor": 0.85}] * 3, start="2024-03-15 20:00:00")
    assert one(E.period_efficiency(m2)).efficiency_score == 97.5


def test_histogram_single_value_and_closed_last_bin(spark):
    h = K.voltage_histogram(readings(spark, [{"voltage": 220.0}] * 3)).collect()
    assert len(h) == 50 and {x.bin: x["count"] for x in h if x["count"]} == {26: 3}
    h2 = K.histogram(readings(spark, [{"voltage": v} for v in [200.0, 210.0, 220.0]]), "voltage", 2).collect()
    assert {x.bin: x["count"] for x in h2} == {1: 1, 2: 2}


def test_profile_and_null_counts(spark):
    m = readings(spark, [100.0, None, 300.0])
    nulls = {x.column: x.missing for x in P.null_counts(m).collect()}
    assert nulls["active_power"] == 1 and nulls["voltage"] == 0
    stats = {x.column: x for x in P.profile_stats(m).collect()}
    assert stats["active_power"].mean == 200.0 and stats["active_power"].std == 141.42


def test_single_row_std_is_null(spark):
    q = one(P.power_quality(readings(spark, [100.0])))
    assert q.voltage_std is None and q.voltage_stability == "good"


def test_clean_nan_recurses_into_structs_and_arrays(spark):
    df = spark.createDataFrame([((1.0, float("nan")), [float("inf"), 2.0], "x")],
                               "s struct<a: double, b: double>, arr array<double>, t string")
    row = clean_nan(df).first()
    assert (row.s.a, row.s.b) == (1.0, None) and list(row.arr) == [None, 2.0] and row.t == "x"


def test_season_labels_and_factor(spark):
    from meterlake.functions.calendar import season_factor, season_name
    rows = [("2024-01-15 07:00:00",), ("2024-07-01 13:00:00",), ("2024-04-01 13:00:00",), ("2024-12-01 20:00:00",)]
    df = spark.createDataFrame(rows, "t string").select(F.to_timestamp_ntz("t").alias("ts"))
    got = [(r.f, r.s, r.legacy) for r in df.select(season_factor().alias("f"), season_name().alias("s"),
                                                    season_name(legacy_labels=True).alias("legacy")).collect()]
    assert got == [(1.5, "winter", "spring"), (1.3, "summer", "autumn"), (1.0, "spring", "summer"),
                   (1.5, "winter", "spring")]


def test_derived_column_edge_cases(spark):
    from meterlake.functions import derive as dv
    df = spark.createDataFrame([(0.0, 0.0, 0.0), (500.0, 0.0, 220.0), (2500.0, 750.0, -1.0)],
                               "p double, q double, v double")
    got = df.select(dv.current_from_power("p", "v").alias("i"), dv.pf_from_pq("p", "q").alias("pf"),
                    dv.power_class("p").alias("c"), dv.power_class("p", 2000.0, 500.0).alias("cm")).collect()
    assert [(r.i, r.c, r.cm) for r in got] == [(0.0, "low", "low"), (500.0 / 220.0, "medium", "low"),
                                              (0.0, "high", "high")]
    assert got[0].pf == 0.95 and got[1].pf == 1.0


def test_register_round_trip_with_gap_and_reset(spark):
    from meterlake.sources.meter import register_to_interval
    regs = [1.0, 1.5, None, 2.5, 0.2, 0.4]          # a missing reading, then a meter reset
    df = spark.createDataFrame([("a", i, f"2024-03-15 00:0{i}:00", e) for i, e in enumerate(regs)],
                               "meter_id string, seq long, t string, energy double") \
        .select("meter_id", "seq", F.to_timestamp_ntz("t").alias("ts"), "energy")
    got = [r.energy for r in register_to_interval(df).orderBy("seq").collect()]
    assert got[0] == 1.0 and got[1] == 0.5 and got[2] is None
    assert got[4] == 0.2 and round(got[5], 9) == 0.2
