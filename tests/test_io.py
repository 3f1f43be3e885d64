"""Meter file scans, rejects, sinks and the upload stream."""
import json
import os
import tempfile

from pyspark.sql import functions as F

from meterlake.plans.reports import analysis_json, analyze, identify
from meterlake.sources.meter import (interval_to_register, load_meter_data, normalise, read_meter,
                                     read_meter_raw, register_to_interval, split_rejects)
from meterlake.sources.sinks import write_json_reports, write_readings
from meterlake.streaming.uploads import analyse_uploads


def _csv(folder, name, lines, header="timestamp,voltage,current,active_power,reactive_power,power_factor,energy"):
    path = os.path.join(folder, name)
    with open(path, "w") as f:
        f.write(header + "\n" + "\n".join(lines) + "\n")
    return path


def test_csv_by_name_bad_cells_and_rejects(spark):
    d = tempfile.mkdtemp(prefix="ml-io-")
    # columns in a different order than the contract; one bad number, one bad time
    _csv(d, "m1.csv", ["220,2024-03-15 00:00:00,100,1.0,0.95,30,0.0017",
                       "221,2024-03-15 00:01:00,abc,1.0,0.95,30,0.0017",
                       "222,not a time,300,1.0,0.95,30,0.0050"],
         header="voltage,timestamp,active_power,current,power_factor,reactive_power,energy")
    raw = read_meter_raw(spark, d)
    good, bad = split_rejects(normalise(raw))
    g = sorted(good.collect(), key=lambda r: r.ts)
    assert [r.active_power for r in g] == [100.0, None] and g[0].voltage == 220.0
    assert g[0].meter_id == "m1.csv"
    assert bad.count() == 1


def test_missing_path_is_a_status_not_an_exception(spark):
    st = load_meter_data(spark, "/nonexistent/meter/folder")
    assert st["success"] is False and st["data"] is None and st["error"]


def test_energy_derived_when_missing_and_register_round_trip(spark):
    d = tempfile.mkdtemp(prefix="ml-io-")
    _csv(d, "m2.csv", ["2024-03-15 00:00:00,220,1,600"], header="timestamp,voltage,current,active_power")
    m = read_meter(spark, d)
    assert m.first().energy == 600.0 / 60.0 / 1000.0
    rows = spark.createDataFrame([("a", i, f"2024-03-15 00:0{i}:00", e) for i, e in enumerate([0.1, 0.2, 0.1, 0.3])],
                                 "meter_id string, seq long, t string, energy double") \
        .select("meter_id", "seq", F.to_timestamp_ntz("t").alias("ts"), "energy")
    reg = interval_to_register(rows)
    back = register_to_interval(reg.drop("energy").withColumnRenamed("energy_register", "energy"))
    assert [round(r.energy, 9) for r in back.orderBy("seq").collect()] == [0.1, 0.2, 0.1, 0.3]


def test_write_readings_and_json_reports(spark):
    d = tempfile.mkdtemp(prefix="ml-io-")
    _csv(d, "m3.csv", [f"2024-03-{15 + i // 3} 0{i % 3}:00:00,220,1,{100 + i},30,0.95,0.002" for i in range(6)])
    m = read_meter(spark, d)
    out = tempfile.mkdtemp(prefix="ml-out-")
    write_readings(m, out + "/readings")
    back = spark.read.parquet(out + "/readings")
    assert back.count() == 6 and "date" in back.columns
    write_json_reports(analysis_json(m), out + "/reports")
    docs = [json.loads(r.value) for r in spark.read.text(out + "/reports").collect()]
    assert len(docs) == 1 and docs[0]["data_summary"]["total_records"] == 6


def test_dispatchers(spark):
    req = spark.createDataFrame([(150.0,), (60000.0,), (-1.0,)], "power double")
    got = identify(req).collect()
    assert sorted(r.power for r in got if r.status == "rejected") == [-1.0, 60000.0]
    d = tempfile.mkdtemp(prefix="ml-io-")
    _csv(d, "m4.csv", ["2024-03-15 00:00:00,220,1,100,30,0.95,0.002"])
    m = read_meter(spark, d)
    assert "peak_hours" in analyze(m, "unknown-kind").columns
    assert "hour" in analyze(m, "hourly").columns
    from meterlake.plans.reports import efficiency_view
    one = efficiency_view(m, "tv").collect()
    assert len(one) == 1 and one[0].appliance == "tv" and one[0].status == "running"
    assert "best_period" in efficiency_view(m).columns
    from meterlake.plans.reports import CHARTS, chart_data
    assert chart_data(m, "pie-of-the-day") is None
    assert all(chart_data(m, k).count() >= 1 for k in CHARTS)


def test_upload_stream_analyses_new_files(spark):
    inp = tempfile.mkdtemp(prefix="ml-in-")
    out = tempfile.mkdtemp(prefix="ml-out-")
    ck = tempfile.mkdtemp(prefix="ml-ck-")
    _csv(inp, "meterA.csv", [f"2024-03-15 00:{i:02d}:00,220,1,{100 + 10 * i},30,0.95,0.002" for i in range(20)])
    q = analyse_uploads(spark, inp, out, checkpoint=ck)
    q.awaitTermination(120)
    docs = spark.read.json(out).collect()
    assert len(docs) == 1 and docs[0].meter_id == "meterA.csv"


def test_format_inference_and_parquet_round_trip(spark):
    from meterlake.sources.meter import infer_format
    assert [infer_format(p) for p in ["a/b.CSV", "x.parquet", "y.jsonl", "z.orc", "dir/"]] == \
        ["csv", "parquet", "json", "orc", "csv"]
    d = tempfile.mkdtemp(prefix="ml-io-")
    _csv(d, "m5.csv", ["2024-03-15 00:00:00,220,1,100,30,0.95,0.002"])
    raw = read_meter_raw(spark, d)
    out = tempfile.mkdtemp(prefix="ml-pq-") + "/m5.parquet"
    raw.write.parquet(out)
    m = read_meter(spark, out, fmt=None)
    assert m.first().active_power == 100.0


def test_reference_labels(spark):
    from meterlake.functions.labels import with_reference_labels
    from meterlake.operators.profile import power_quality
    from conftest import readings
    q = with_reference_labels(power_quality(readings(spark, [100.0, 120.0]))).first()
    assert q.voltage_stability_label == "良好" and q.pf_assessment_label == "良好"


def test_daily_energy_stream_with_watermark(spark):
    from meterlake.streaming.uploads import daily_energy_stream, meter_file_stream
    inp = tempfile.mkdtemp(prefix="ml-in-")
    _csv(inp, "meterB.csv", [f"2024-03-{15 + i // 4} {6 * (i % 4):02d}:00:00,220,1,100,30,0.95,0.5" for i in range(8)])
    stream = daily_energy_stream(meter_file_stream(spark, inp))
    q = (stream.writeStream.outputMode("update").format("memory").queryName("daily_energy_test")
         .option("checkpointLocation", tempfile.mkdtemp(prefix="ml-ck-")).trigger(availableNow=True).start())
    q.awaitTermination(120)
    got = sorted((str(r.day.start)[:10], r.total_energy, r.readings) for r in spark.table("daily_energy_test").collect())
    assert got == [("2024-03-15", 2.0, 4), ("2024-03-16", 2.0, 4)]


def test_fleet_report_job(spark):
    from meterlake.plans.batch import run_fleet_report
    inp = tempfile.mkdtemp(prefix="ml-in-")
    for k in ("m1", "m2"):
        _csv(inp, f"{k}.csv", [f"2024-03-{15 + i // 24} {i % 24:02d}:00:00,{215 + i % 9},1,{100 + 37 * (i % 11)},30,0.95,0.002"
                               for i in range(72)] + ["bad time,220,1,100,30,0.95,0.002"])
    out = tempfile.mkdtemp(prefix="ml-job-")
    written = run_fleet_report(spark, inp, out)
    assert spark.read.parquet(written["readings"]).count() == 144
    assert spark.read.parquet(written["rejects"]).count() == 2
    alerts = spark.read.parquet(written["alert_level"]).collect()
    assert sorted(r.meter_id for r in alerts) == ["m1.csv", "m2.csv"]
    assert spark.read.text(written["analysis_json"]).count() == 2


def test_analysis_json_keeps_null_fields(spark):
    from conftest import readings
    m = readings(spark, [100.0] * 5 + [3000.0] + [100.0] * 5)
    doc = json.loads(analysis_json(m).first().analysis)
    details = doc["alerts"]["details"]
    assert details and all("recommendation" in d and "magnitude" in d for d in details)
    assert any(d["magnitude"] is None for d in details) or any(d["recommendation"] is None for d in details)


def test_identify_ranks_and_labels(spark):
    from meterlake.functions.labels import with_reference_labels
    req = spark.createDataFrame([(150.0,), (1200.0,)], "power double")
    got = {(r.power, r["rank"]): r.appliance for r in identify(req).collect()}
    assert got[(150.0, 1)] == "refrigerator" and got[(1200.0, 1)] == "microwave" and len(got) == 6
    lab = with_reference_labels(spark.createDataFrame([("night", "Sun", "high")], "period string, day string, "
                                                                                   "alert_level string")).first()
    assert (lab.period_label, lab.day_label, lab.alert_level_label) == ("凌晨", "周日", "🔴 高")
