"""The ``meter_readings`` contract."""

from __future__ import annotations

from pyspark.sql import types as T

# Columns of a meter file as written by meters (CSV header names).
FILE_SCHEMA = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("voltage", T.DoubleType()),
    T.StructField("current", T.DoubleType()),
    T.StructField("active_power", T.DoubleType()),
    T.StructField("reactive_power", T.DoubleType()),
    T.StructField("power_factor", T.DoubleType()),
    T.StructField("energy", T.DoubleType()),
])

MEASURES = ["voltage", "current", "active_power", "reactive_power", "power_factor", "energy"]

# Normalised readings: one row per (meter_id, ts, seq); seq breaks timestamp ties
# and keeps file order.
READINGS_COLUMNS = ["meter_id", "seq", "ts"] + MEASURES

TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"
# formats a time column may use, tried in order (file loads)
TIME_FORMATS = (TIME_FORMAT, "yyyy/MM/dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy/MM/dd HH:mm", "yyyyMMdd HH:mm:ss",
                "yyyy/MM/dd")
