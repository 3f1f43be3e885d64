"""Derived inputs from the driver's test tables.

``meter_readings_from_events`` is the portable recipe that turns the ``events``
table into a fleet of ten meters (documented in FIXTURES.md §2); the same SQL
text is used by the DuckDB oracle (:data:`MR_SQL`). ``file_inventory`` and
``object_keys`` derive path / key inventories from ``events`` and ``pages``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.functions.numeric import r


# Schemas of the driver tables this package reads (identical at every scale
# factor); an explicit schema spares the footer reads of schema inference.
TABLE_SCHEMAS = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "pages": "page_id bigint, url string, html string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reader = spark.read
    if name in TABLE_SCHEMAS:
        reader = reader.schema(TABLE_SCHEMAS[name])
    return reader.parquet(f"{sf_dir}/{name}.parquet")


def meter_readings_from_events(events: DataFrame, keep=()) -> DataFrame:
    """``keep``: extra ``events`` columns carried along (e.g. ``event_type``).
    One projection straight off the scan."""
    seq = F.col("event_id")
    meter = F.col("user_id") % 10
    uplift = F.when((meter == 3) & (F.weekday("ts") >= 5), F.lit(1.6)).otherwise(F.lit(1.0))
    volt = F.lit(190.0) + ((seq * 37) % 61).cast("double")
    power = F.col("value") * 7.0 * uplift
    pf = F.lit(0.80) + ((seq * 13) % 20).cast("double") / 100.0
    return events.select(
        meter.alias("meter_id"), seq.alias("seq"), "ts",
        volt.alias("voltage"),
        (power / volt).alias("current"),
        power.alias("active_power"),
        r(power * F.tan(F.acos(pf)), 2).alias("reactive_power"),
        pf.alias("power_factor"),
        (power / 60.0 / 1000.0).alias("energy"),
        *keep,
    )


def meter_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return meter_readings_from_events(read_table(spark, sf_dir, "events"))


# DuckDB twin of meter_readings_from_events (weekday: isodow - 1).
MR_SQL = """
mr_base AS (
  SELECT event_id AS seq, user_id % 10 AS meter_id, ts, value,
         CASE WHEN user_id % 10 = 3 AND (isodow(ts) - 1) >= 5 THEN CAST(1.6 AS DOUBLE)
              ELSE CAST(1.0 AS DOUBLE) END AS uplift
  FROM events),
meter_readings AS (
  SELECT meter_id, seq, ts,
         CAST(190.0 AS DOUBLE) + CAST((seq * 37) % 61 AS DOUBLE) AS voltage,
         value * CAST(7.0 AS DOUBLE) * uplift / (CAST(190.0 AS DOUBLE) + CAST((seq * 37) % 61 AS DOUBLE)) AS "current",
         value * CAST(7.0 AS DOUBLE) * uplift AS active_power,
         round_even(value * CAST(7.0 AS DOUBLE) * uplift
                    * tan(acos(CAST(0.80 AS DOUBLE) + CAST((seq * 13) % 20 AS DOUBLE) / CAST(100.0 AS DOUBLE))), 2) AS reactive_power,
         CAST(0.80 AS DOUBLE) + CAST((seq * 13) % 20 AS DOUBLE) / CAST(100.0 AS DOUBLE) AS power_factor,
         value * CAST(7.0 AS DOUBLE) * uplift / CAST(60.0 AS DOUBLE) / CAST(1000.0 AS DOUBLE) AS energy
  FROM mr_base)"""

def raw_meter_text(spark: SparkSession, sf_dir: str, keep=()) -> DataFrame:
    """Meter files as text, derived from ``events``: several time forms, tied, missing and
    unreadable times, holes, words and non-finite numbers among the cells. ``register`` is a
    counter that starts again every 500 events; ``exact_time`` has no ties."""
    n = F.col("event_id")
    time = lambda form: F.date_format("ts", form)
    stamp = (F.when(n % 8 == 0, F.lit(None)).when(n % 8 == 1, F.lit("not a time"))
             .when(n % 8 == 2, time("yyyy-MM-dd'T'HH:mm:ss")).when(n % 8 == 3, time("yyyy/MM/dd HH:mm:ss"))
             .when(n % 8 == 4, time("yyyyMMdd HH:mm:ss")).when(n % 8 == 5, time("yyyy-MM-dd HH:mm"))
             .when(n % 8 == 6, F.concat(F.lit("  "), time("yyyy-MM-dd HH:mm:ss"))).otherwise(time("yyyy-MM-dd HH:mm:ss")))
    volt = (F.when(n % 11 == 0, F.lit("")).when(n % 11 == 1, F.lit("n/a")).when(n % 11 == 2, F.lit("NaN"))
            .when(n % 11 == 3, F.lit("Infinity")).otherwise((190 + (n * 37) % 61).cast("string")))
    watt = F.when(n % 13 == 5, F.lit("-Infinity")).otherwise(F.floor(F.col("value") * 100).cast("string"))
    return read_table(spark, sf_dir, "events").select(
        (F.col("user_id") % 10).cast("string").alias("meter"), stamp.alias("timestamp"), volt.alias("voltage"),
        watt.alias("active_power"), (n % 500).cast("string").alias("register"),
        F.when(n % 8 != 0, time("yyyy-MM-dd HH:mm:ss.SSSSSS")).alias("exact_time"), *keep)


# What those cells mean: the readings a reader must get (rows without a time are rejects).
RAW_METER_SQL = """
raw_readings AS (
  SELECT CAST(user_id % 10 AS VARCHAR) AS meter_id,
         CASE WHEN event_id % 8 IN (0, 1) THEN NULL WHEN event_id % 8 = 5 THEN date_trunc('minute', ts)
              ELSE date_trunc('second', ts) END AS ts,
         CASE WHEN event_id % 11 > 3 THEN CAST(190 + (event_id * 37) % 61 AS DOUBLE) END AS voltage,
         CASE WHEN event_id % 13 <> 5 THEN CAST(floor(value * 100) AS DOUBLE) END AS active_power,
         CAST(event_id % 500 AS DOUBLE) AS register, CASE WHEN event_id % 8 <> 0 THEN ts END AS exact_time
  FROM events)"""

def raw_meter_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines ``meter,timestamp,voltage,active_power`` of such files; one in nine has two cells too
    many, one in nine a cell too few."""
    raw = raw_meter_text(spark, sf_dir, keep=["event_id"])
    cells = [F.coalesce(F.col(c), F.lit("")) for c in LINE_COLUMNS]
    n = F.col("event_id") % 9
    return raw.select(F.when(n == 0, F.concat_ws(",", *cells, F.lit("x"), F.lit("y"))).when(n == 1, F.concat_ws(",", *cells[:-1]))
                      .otherwise(F.concat_ws(",", *cells)).alias(",".join(LINE_COLUMNS)))


LINE_COLUMNS = ("meter", "timestamp", "voltage", "active_power")

RAW_LINES_SQL = """
cells AS (
  SELECT event_id, CAST(user_id % 10 AS VARCHAR) AS meter,
         CASE event_id % 8 WHEN 0 THEN '' WHEN 1 THEN 'not a time' WHEN 2 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S')
           WHEN 3 THEN strftime(ts, '%Y/%m/%d %H:%M:%S') WHEN 4 THEN strftime(ts, '%Y%m%d %H:%M:%S')
           WHEN 5 THEN strftime(ts, '%Y-%m-%d %H:%M') WHEN 6 THEN '  ' || strftime(ts, '%Y-%m-%d %H:%M:%S')
           ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS stamp,
         CASE event_id % 11 WHEN 0 THEN '' WHEN 1 THEN 'n/a' WHEN 2 THEN 'NaN' WHEN 3 THEN 'Infinity'
           ELSE CAST(190 + (event_id * 37) % 61 AS VARCHAR) END AS volt,
         CASE WHEN event_id % 13 = 5 THEN '-Infinity' ELSE CAST(CAST(floor(value * 100) AS BIGINT) AS VARCHAR) END AS watt
  FROM events)"""

# Synthetic file paths: one per event, extension chosen by event_id % 8, a
# query string on every fifth one.
_SUFFIXES = [".csv", ".JPG", ".tar.gz", "", ".mp4", ".wav", ".PDF", ".bin"]


def file_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, source) from ``events`` (synthetic local paths) and ``pages`` (URLs)."""
    ev = read_table(spark, sf_dir, "events")
    suffix = F.element_at(F.array(*[F.lit(s) for s in _SUFFIXES]), (F.col("event_id") % 8 + 1).cast("int"))
    query = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("?v="), F.col("event_id").cast("string"))) \
        .otherwise(F.lit(""))
    paths = ev.select(F.concat(F.lit("/data/"), F.col("event_type"), F.lit("_"),
                               F.col("event_id").cast("string"), suffix, query).alias("path"),
                      F.lit("events").alias("source"))
    urls = read_table(spark, sf_dir, "pages").select(F.col("url").alias("path"), F.lit("pages").alias("source"))
    return paths.unionByName(urls)


FILE_INVENTORY_SQL = """
file_inventory AS (
  SELECT '/data/' || event_type || '_' || CAST(event_id AS VARCHAR)
         || (['.csv', '.JPG', '.tar.gz', '', '.mp4', '.wav', '.PDF', '.bin'])[CAST(event_id % 8 + 1 AS INTEGER)]
         || CASE WHEN event_id % 5 = 0 THEN '?v=' || CAST(event_id AS VARCHAR) ELSE '' END AS path,
         'events' AS source
  FROM events
  UNION ALL
  SELECT url AS path, 'pages' AS source FROM pages)"""


def object_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key_id, key, size): candidate object keys derived from ``events``; one in
    six is well formed, the others carry one defect each (double slash, edge
    slash, space, blank, over 1024 bytes). ``size`` is a synthetic byte size."""
    ev = read_table(spark, sf_dir, "events")
    base = F.concat(F.col("event_type"), F.lit("/"), F.col("event_id").cast("string"), F.lit(".csv"))
    k = F.col("event_id") % 6
    key = (F.when(k == 0, base)
           .when(k == 1, F.concat(F.col("event_type"), F.lit("//"), F.col("event_id").cast("string")))
           .when(k == 2, F.concat(base, F.lit("/")))
           .when(k == 3, F.concat(F.col("event_type"), F.lit(" "), F.col("event_id").cast("string")))
           .when(k == 4, F.lit("   "))
           .otherwise(F.concat(F.repeat(F.lit("x"), 1020), F.col("event_id").cast("string"))))
    size = F.floor(F.col("value") * 1000000.0).cast("long")
    return ev.select(F.col("event_id").alias("key_id"), key.alias("key"), size.alias("size"))


OBJECT_KEYS_SQL = """
object_keys AS (
  SELECT event_id AS key_id,
         CASE event_id % 6
           WHEN 0 THEN event_type || '/' || CAST(event_id AS VARCHAR) || '.csv'
           WHEN 1 THEN event_type || '//' || CAST(event_id AS VARCHAR)
           WHEN 2 THEN event_type || '/' || CAST(event_id AS VARCHAR) || '.csv' || '/'
           WHEN 3 THEN event_type || ' ' || CAST(event_id AS VARCHAR)
           WHEN 4 THEN '   '
           ELSE repeat('x', 1020) || CAST(event_id AS VARCHAR) END AS key,
         CAST(floor(value * CAST(1000000.0 AS DOUBLE)) AS BIGINT) AS size
  FROM events)"""
