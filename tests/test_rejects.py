"""Malformed lines, unreadable files, rewritten days."""

from __future__ import annotations

import gzip

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from meterlake.sources.meter import file_status, load_meter_data, normalise, read_meter, read_meter_raw, split_rejects
from meterlake.sources.sinks import committed_days, rewrite_days, write_readings
from conftest import readings

HEAD = "timestamp,voltage,current,active_power\n"


def test_lines_with_other_cells_than_the_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text(HEAD + "2024-01-01 00:00:00,220,1,210\n2024-01-01 00:01:00,220,1,210,8,9\n2024-01-01 00:02:00,220,1\n,220,1,5\nx,1,1,1\n")
    (tmp_path / "b.csv").write_text("active_power,timestamp\n1,2024-01-01 00:00:00\n2\n")
    x = normalise(read_meter_raw(spark, str(tmp_path)), reasons=True)
    good, bad = split_rejects(x)
    assert sorted(r.meter_id for r in good.collect()) == ["a.csv", "b.csv"]
    assert sorted((r.file, r.reason, r.record) for r in bad.collect() if r.record) == [
        ("a.csv", "malformed", "2024-01-01 00:01:00,220,1,210,8,9"), ("a.csv", "malformed", "2024-01-01 00:02:00,220,1"), ("b.csv", "malformed", "2")]
    rec = load_meter_data(spark, str(tmp_path))
    assert {(r.file, r.reason): r.rows for r in rec["reject_counts"].collect()} == {
        ("a.csv", "malformed"): 2, ("a.csv", "no_time"): 1, ("a.csv", "bad_time"): 1, ("b.csv", "malformed"): 1}
    assert read_meter(spark, str(tmp_path)).count() == 2
    # without reasons a malformed line is still no reading
    assert split_rejects(normalise(read_meter_raw(spark, str(tmp_path))))[0].count() == 2


def test_rows_without_a_meter_are_quarantined(spark, tmp_path):
    (tmp_path / "a.csv").write_text("meter,timestamp,active_power\n1,2024-01-01 00:00:00,5\n,2024-01-01 00:00:00,5\n  ,bad,5\n")
    good, bad = split_rejects(normalise(read_meter_raw(spark, str(tmp_path)), meter_id="meter", reasons=True))
    assert good.count() == 1 and [r.reason for r in bad.collect()] == ["no_meter"] * 2


def test_unreadable_files_are_named_and_the_others_read(spark, tmp_path):
    ok = HEAD + "2024-01-01 00:00:00,220,1,210\n"
    (tmp_path / "ok.csv").write_text(ok)
    (tmp_path / "bad.csv.gz").write_bytes(b"this is no gzip")
    rec = load_meter_data(spark, str(tmp_path))
    assert rec["success"] and rec["data"].count() == 1
    assert {f["file"].rsplit("/", 1)[1]: f["success"] for f in rec["files"]} == {"ok.csv": True, "bad.csv.gz": False}
    assert all(f["success"] or f["error"] for f in rec["files"])
    alone = load_meter_data(spark, str(tmp_path / "bad.csv.gz"))
    assert not alone["success"] and alone["error"] and alone["data"] is None and not alone["files"][0]["success"]


def test_corrupt_parquet(spark, tmp_path):
    spark.range(3).selectExpr("'2024-01-01 00:00:00' AS timestamp", "1.0 AS voltage").coalesce(1).write.parquet(str(tmp_path / "t.parquet"))
    (tmp_path / "broken.parquet").write_bytes(b"PAR1 but not really")
    rec = load_meter_data(spark, str(tmp_path / "broken.parquet"), fmt="parquet")
    assert not rec["success"] and rec["error"]
    both = load_meter_data(spark, [str(tmp_path / "t.parquet"), str(tmp_path / "broken.parquet")], fmt="parquet", verify=True)
    assert both["success"] and both["data"].count() == 3 and sum(not f["success"] for f in both["files"]) == 1


def test_a_cut_gzip_is_found_by_reading_it(spark, tmp_path):
    data = gzip.compress((HEAD + "".join(f"2024-01-01 00:00:{i % 60:02d},220,1,{i * 7919 % 3001}\n" for i in range(200_000))).encode())
    (tmp_path / "cut.csv.gz").write_bytes(data[:len(data) // 2])
    assert not file_status(spark, str(tmp_path / "cut.csv.gz"))[0]["success"]
    assert not load_meter_data(spark, str(tmp_path / "cut.csv.gz"), verify=True)["success"]


def test_a_missing_path(spark):
    rec = load_meter_data(spark, "/nonexistent/meter/folder")
    assert not rec["success"] and rec["files"] == []


def files(path):
    return {p.relative_to(path): p.read_bytes() for p in path.rglob("*") if p.is_file() and "_commits" not in str(p) and not p.name.startswith((".", "_"))}


def test_one_day_is_rewritten(spark, tmp_path):
    m = readings(spark, [float(i) for i in range(96)], step_minutes=60)  # four days
    path = tmp_path / "t"
    write_readings(m, str(path))
    before = files(path)
    rewrite_days(m.withColumn("voltage", F.lit(1.0)), str(path), ["2024-03-16"])
    after = files(path)
    changed = {str(k.parent) for k in before.keys() ^ after.keys()} | {str(k.parent) for k in before.keys() & after.keys() if before[k] != after[k]}
    assert changed == {"date=2024-03-16"}
    table = spark.read.parquet(str(path))
    assert table.count() == 96 and table.where("voltage = 1").count() == 24
    assert [(str(r.date), r.rows) for r in committed_days(spark, str(path)).collect()] == [("2024-03-16", 24)]
    # a job that fails leaves files and markers as they are, and can be run again
    failing = m.withColumn("voltage", F.when(F.col("seq") == 50, F.raise_error(F.lit("lost"))).otherwise(F.lit(2.0)).cast("double"))
    with pytest.raises(PySparkException):
        rewrite_days(failing, str(path), ["2024-03-17"])
    assert files(path) == after and committed_days(spark, str(path)).count() == 1
    rewrite_days(m.withColumn("voltage", F.lit(2.0)), str(path), ["2024-03-17"])
    assert spark.read.parquet(str(path)).where("voltage = 2").count() == 24 and committed_days(spark, str(path)).count() == 2
