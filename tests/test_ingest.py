"""Ingest: columns by header name, time forms, registers with bad times, rebalanced writes, mixed uploads."""

from __future__ import annotations

import glob

import pytest

from meterlake.operators import features as L
from meterlake.operators.anomalies import rolling_power
from meterlake.sources.meter import normalise, read_meter, read_meter_raw, split_rejects
from meterlake.sources.sinks import write_readings
from meterlake.streaming.uploads import analyse_uploads

COLS = ["timestamp", "voltage", "current", "active_power", "reactive_power", "power_factor", "energy"]
ROW = {"timestamp": "2024-01-01 00:00:00", "voltage": "220.0", "current": "1.0", "active_power": "210.0",
       "reactive_power": "10.0", "power_factor": "0.9", "energy": "0.0035"}


def _write(path, cols, *rows):
    path.write_text("\n".join([",".join(cols)] + [",".join((ROW | r)[c] for c in cols) for r in rows]) + "\n")


def test_columns_by_name_in_any_order_and_number(spark, tmp_path):
    _write(tmp_path / "a.csv", COLS, {})
    _write(tmp_path / "b.csv", COLS[::-1], {})
    _write(tmp_path / "c.csv", ["voltage", "timestamp", "active_power", "current"], {})
    (tmp_path / "d.csv").write_text("")
    got = {r.meter_id: r for r in read_meter(spark, str(tmp_path)).collect()}
    assert sorted(got) == ["a.csv", "b.csv", "c.csv"]
    for name, r in got.items():
        assert (r.voltage, r.current, r.active_power) == (220.0, 1.0, 210.0)
        assert r.energy == pytest.approx(0.0035)  # c.csv has no energy: from power
        assert r.power_factor == (None if name == "c.csv" else 0.9)


def test_one_format_per_scan(spark):
    with pytest.raises(ValueError):
        read_meter_raw(spark, ["x.csv", "y.json"], fmt=None)


@pytest.mark.parametrize("text", ["2024-01-02 03:04:00", "2024-01-02T03:04:00", "2024/01/02 03:04:00",
                                  "2024-01-02 03:04", " 2024-01-02 03:04:00 ", "20240102 03:04:00"])
def test_time_forms(spark, tmp_path, text):
    _write(tmp_path / "a.csv", COLS, {"timestamp": text})
    [r] = read_meter(spark, str(tmp_path)).collect()
    assert str(r.ts) == "2024-01-02 03:04:00"


def test_register_rejects_keep_their_rows_and_leave_the_others_alone(spark, tmp_path):
    _write(tmp_path / "a.csv", COLS, {"energy": "5.0"}, {"timestamp": "bad", "energy": "100.0"},
           {"timestamp": "2024-01-01 00:01:00", "energy": "7.0"}, {"timestamp": "", "energy": "50.0"})
    good, bad = split_rejects(normalise(read_meter_raw(spark, str(tmp_path)), energy="register"))
    assert [r.energy for r in good.orderBy("ts").collect()] == [5.0, 2.0]
    assert sorted(r.energy for r in bad.collect()) == [50.0, 100.0]


def test_a_large_day_is_written_as_several_files(spark, tmp_path):
    m = spark.range(200_000).selectExpr("id % 7 AS meter_id", "id AS seq", "timestamp_ntz'2024-01-01 00:00:00' AS ts",
                                        "rand(1) AS voltage")
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    old = spark.conf.get(key)
    spark.conf.set(key, "200k")
    try:
        write_readings(m, str(tmp_path / "out"))
    finally:
        spark.conf.set(key, old)
    assert len(glob.glob(str(tmp_path / "out" / "date=2024-01-01" / "*.parquet"))) > 1
    assert spark.read.parquet(str(tmp_path / "out")).count() == 200_000


def test_uploads_with_different_headers(spark, tmp_path):
    (tmp_path / "in").mkdir()
    _write(tmp_path / "in" / "a.csv", COLS, {})
    _write(tmp_path / "in" / "b.csv", ["active_power", "timestamp", "voltage", "current"], {})
    q = analyse_uploads(spark, str(tmp_path / "in"), str(tmp_path / "out"), checkpoint=str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert {r.meter_id for r in spark.read.json(str(tmp_path / "out")).collect()} == {"a.csv", "b.csv"}


def test_rolling_uses_the_raw_values(spark):
    m = spark.createDataFrame([(1, i, v) for i, v in enumerate([0.001, 0.002, 0.004])], "meter_id int, seq long, active_power double") \
        .selectExpr("*", "timestamp_ntz'2024-01-01 00:00:00' AS ts")
    got = [r.rolling_mean for r in rolling_power(m).orderBy("seq").collect()]
    assert got == pytest.approx([0.001, 0.0015, 0.007 / 3])


def test_superposition_adds_one_power_per_device_and_household(spark):
    rows = [(1, "kettle", 1000.0)] * 3 + [(1, "tv", 100.0), (1, "tv", 300.0), (2, "tv", 50.0), (2, "mixed", 9.0)]
    s = spark.createDataFrame(rows, "meter_id int, appliance_id string, active_power double") \
        .selectExpr("*", "appliance_id AS appliance_name", "timestamp_ntz'2024-01-01 05:10:00' AS ts")
    got = {r.meter_id: (r.power, r.n_devices, r.appliance_name) for r in L.load_superposition(s).collect()}
    assert got == {1: (1200.0, 2, "kettle+tv"), 2: (50.0, 1, "tv")}
