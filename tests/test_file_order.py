"""Tied times over several files of one meter resolve alike, however the files are split."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from meterlake.operators.segments import power_steps
from meterlake.sources.meter import read_meter


def _lines(first, n):
    return "".join(f"m,2024-01-01 00:0{i % 3}:00,{first + i}\n" for i in range(n))


@pytest.fixture
def folder(tmp_path):
    for k, n in (("a b", 700), ("c", 400), ("ü", 90)):
        (tmp_path / f"{k}.csv").write_text("meter,timestamp,active_power\n" + _lines(1000 * n, n))
    return tmp_path


@pytest.mark.parametrize("fmt", ["csv", "json", "parquet"])
def test_ties_resolve_alike_under_any_split_size(spark, folder, fmt):
    path = str(folder)
    if fmt != "csv":
        path = str(folder / "other")
        spark.read.option("header", True).csv(str(folder)).repartition(3, "active_power").write.format(fmt).save(path)
    seen = []
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = {k: spark.conf.get(k) for k in keys}
    for size, cost in (("128m", "4m"), ("700b", "1b"), ("5000b", "100b")):
        spark.conf.set(keys[0], size)
        spark.conf.set(keys[1], cost)
        m = read_meter(spark, path, fmt=fmt, meter_id="meter")
        seen.append(sorted((r.active_power, r.power_step or 0.0) for r in power_steps(m).collect()))
        one = m.withColumn("file", F.floor(F.col("active_power") / 1000)).select("file", "seq", "active_power").collect()
    for k, v in old.items():
        spark.conf.set(k, v)
    assert len(seen[0]) == 1190 and seen[0] == seen[1] == seen[2]
    assert len({r.seq for r in one}) == 1190 and min(r.seq for r in one) >= 0


def test_file_order_within_a_file(spark, folder):
    m = read_meter(spark, str(folder / "c.csv"), meter_id="meter")
    assert [r.active_power for r in m.orderBy("seq").collect()] == [400_000.0 + i for i in range(400)]
