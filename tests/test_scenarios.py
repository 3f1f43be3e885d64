"""Day scenarios as small hand-made meters with the alerts they must raise."""
import json

import pytest

from conftest import readings
from meterlake import dims
from meterlake.operators import anomalies as H
from meterlake.operators import efficiency as E
from meterlake.plans import reports as J

RAMP = [100.0 + 45 * i for i in range(1, 21)]


def day(power=None, volt=None, n=400):
    """One day of quiet readings; ``power`` replaces the powers from row 100 on, ``volt`` single voltages."""
    p = [100.0] * n
    p[100:100 + len(power or [])] = power or []
    return [{"active_power": x, "voltage": (volt or {}).get(i, 225.0)} for i, x in enumerate(p)]


SCENARIOS = {
    "none": (day(), set()),
    "low": (day(volt={50: 200.0}), {"voltage_sag"}),
    "medium": (day(RAMP, {50: 200.0, 60: 190.0}),
               {"voltage_out_of_range", "voltage_sag", "sudden_power_change", "power_drop"}),
    "high": (day(RAMP[::-1]), {"sudden_power_change", "power_spike"}),
}


@pytest.mark.parametrize("level", sorted(SCENARIOS))
def test_alert_level(spark, level):
    rows, kinds = SCENARIOS[level]
    m = readings(spark, rows)
    r = H.alert_level(m).first()
    text = {code: (desc, message) for code, desc, message in dims.ALERT_LEVELS}
    assert r.alert_level == level and (r.alert_level_description, r.summary_message) == text[level]
    assert {x.type for x in H.anomaly_union(m).collect()} == kinds and r.total_anomalies == len(kinds)


def test_causes_and_severities(spark):
    m = readings(spark, SCENARIOS["medium"][0])
    causes = {x.type: x.possible_causes for x in H.anomaly_union(m).collect()}
    assert causes["voltage_sag"] is None and causes["power_drop"] == " | ".join(dims.ANOMALY_TYPES[5][4])
    p = H.power_step_anomalies(m).first()
    assert (p.high_severity_count, p.medium_severity_count) == (0, 2)


def test_samples_name_the_readings(spark):
    got = H.anomaly_samples(readings(spark, SCENARIOS["medium"][0])).collect()
    assert sorted((x.type, x.sample_rank, x.at[11:16], x.value) for x in got) == [
        ("voltage_out_of_range", 1, "01:00", 190.0), ("voltage_sag", 1, "00:50", 200.0)]


def test_abnormal_day_is_sampled(spark):
    rows = [{"active_power": 100.0, "energy": 30.0 if d == 7 else 1.0} for d in range(10)]
    got = H.anomaly_samples(readings(spark, rows, step_minutes=1440)).collect()
    assert [(x.type, x.ord, x.at, x.value, x.z_score, x.deviation) for x in got] == [
        ("daily_consumption_anomaly", 7, "2024-03-22", 30.0, 3.0, "high")]


def test_analysis_names_level_and_days(spark):
    doc = json.loads(J.analysis_json(readings(spark, SCENARIOS["low"][0])).first().analysis)
    assert doc["alerts"]["summary_message"] == dims.ALERT_LEVELS[2][2]
    assert doc["daily"]["max_daily_energy"] == doc["daily"]["min_daily_energy"] and doc["daily"]["energy_variance"] is None


def test_appliance_without_a_standard(spark):
    m = readings(spark, [900.0] * 30)
    got = {r.appliance: r for r in E.appliance_efficiency(m, ["microwave", "air_conditioner", "nothing"],
                                                         interval_minutes=2.0).collect()}
    assert got["microwave"].status == "no_standard" and got["microwave"].error == dims.NO_STANDARD_TEXT % "微波炉"
    assert got["nothing"].error == dims.NO_STANDARD_TEXT % "nothing" and got["nothing"].avg_power is None
    assert (got["air_conditioner"].operating_hours, got["air_conditioner"].error) == (1.0, None)


def test_advice(spark):
    m = readings(spark, [50.0] * 10 + [3000.0], step_minutes=60)
    o, p = E.overall_efficiency(m).first(), E.best_worst_period(m).first()
    assert o.improvement_suggestions.split(" | ")[:2] == dims.IMPROVEMENT_RULES[0][1]
    assert p.best_recommendation == dims.BEST_PERIOD_TEXT % "凌晨" and p.worst_recommendation == dims.WORST_PERIOD_TEXT % "上午"


def test_load_record(spark, tmp_path):
    from meterlake.sources.meter import load_meter_data
    (tmp_path / "m.csv").write_text("active_power,timestamp,voltage\n100,2024-01-01 00:00:00,220\nNaN,2024-01-01 00:01:00,\n5,later,221\n")
    rec = load_meter_data(spark, str(tmp_path / "m.csv"))
    rng = rec["data_range"].first()
    assert rec["success"] and (rng.total_records, rng.time_interval) == (2, dims.INTERVAL_LABEL)
    missing = {r["column"]: r.missing for r in rec["missing_data"].collect()}
    assert (missing["ts"], missing["active_power"], missing["voltage"]) == (1, 1, 1)
    assert rec["rejects"].count() == 1 and rec["stats"].where("column = 'voltage'").first()["mean"] == 220.0
