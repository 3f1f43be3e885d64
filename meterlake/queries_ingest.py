"""Registered queries: ingest of meter files with dirty text."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.catalog import TS_SQL, register, rounded, with_mr
from meterlake.functions.numeric import r
from meterlake.operators.profile import null_counts
from meterlake.session import ensure_checkpoint_dir
from meterlake.sources import meter as S
from meterlake.sources.events import RAW_LINES_SQL, RAW_METER_SQL, meter_readings, raw_meter_lines, raw_meter_text
from meterlake.sources.sinks import committed_days, rewrite_days, write_readings

COLUMNS = ("meter_id", "ts", "voltage", "active_power", "energy")
_ENERGY = "round_even(active_power / 60.0 / 1000.0, 6) AS energy"
_READINGS = f"SELECT meter_id, strftime(ts, '{TS_SQL}') AS ts, voltage, active_power, {_ENERGY} FROM raw_readings"


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_meter_text(spark, sf_dir).select("meter", "timestamp", "voltage", "active_power")


def _normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.normalise(_text(spark, sf_dir), meter_id="meter"), 6, "energy")


@register("time_parsing", f"WITH {RAW_METER_SQL}\n{_READINGS} WHERE ts IS NOT NULL")
def time_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings with a readable time, in any of the accepted forms."""
    return S.split_rejects(_normalised(spark, sf_dir))[0].select(*COLUMNS)


@register("time_rejects", f"WITH {RAW_METER_SQL}\n{_READINGS} WHERE ts IS NULL")
def time_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose time is missing or unreadable, kept with their values."""
    return S.split_rejects(_normalised(spark, sf_dir))[1].select(*COLUMNS)


@register("nan_clean", f"""WITH {RAW_METER_SQL}
""" + "\nUNION ALL\n".join(f"SELECT meter_id, '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS missing "
                           f"FROM raw_readings GROUP BY 1" for c in ("ts", "voltage", "active_power")))
def nan_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing values per meter and column once words and non-finite numbers are NULL."""
    return null_counts(_normalised(spark, sf_dir).select("meter_id", "ts", "voltage", "active_power"))


_REGISTER = f"""WITH {RAW_METER_SQL},
steps AS (SELECT meter_id, exact_time AS ts, register,
                 register - lag(register) OVER (PARTITION BY meter_id ORDER BY exact_time) AS step
          FROM raw_readings WHERE exact_time IS NOT NULL)
SELECT meter_id, strftime(ts, '{TS_SQL}') AS ts, CASE WHEN step >= 0 THEN step ELSE register END AS energy FROM steps
UNION ALL SELECT meter_id, NULL, register FROM raw_readings WHERE exact_time IS NULL"""


@register("register_rejects", _REGISTER)
def register_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cumulative register per interval; rows without a time keep the register value."""
    raw = raw_meter_text(spark, sf_dir).select("meter", F.col("exact_time").alias("timestamp"),
                                               F.col("register").alias("energy"))
    return S.normalise(raw, meter_id="meter", energy="register").select("meter_id", "ts", "energy")


@register("csv_by_name", f"WITH {RAW_METER_SQL}\n{_READINGS} WHERE ts IS NOT NULL")
def csv_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same readings from CSV files whose columns come in different orders: each half of
    the meters is written with its own header to the shared folder and both are read together."""
    folder = _folder(spark, "csv-by-name")
    text, odd = _text(spark, sf_dir), F.col("meter").cast("int") % 2 == 1
    text.where(odd).write.option("header", True).csv(f"{folder}/a")
    text.where(~odd).select(*reversed(text.columns)).write.option("header", True).csv(f"{folder}/b")
    return rounded(S.read_meter(spark, [f"{folder}/a", f"{folder}/b"], meter_id="meter"), 6, "energy").select(*COLUMNS)


@register("meter_rejects", """SELECT 'part-' || CAST(event_id % 3 AS VARCHAR) || '.csv' AS file, reason, count(*) AS rows
FROM (SELECT event_id, CASE WHEN event_id % 17 IN (0, 1) THEN 'no_meter' WHEN event_id % 8 = 0 THEN 'no_time'
                            WHEN event_id % 8 = 1 THEN 'bad_time' END AS reason FROM events) WHERE reason IS NOT NULL GROUP BY 1, 2""")
def meter_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in quarantine by file and reason: no meter (NULL or blank), no time, an unreadable time."""
    n = F.col("event_id")
    raw = raw_meter_text(spark, sf_dir, keep=["event_id"]).select(
        F.when(n % 17 == 0, F.lit(None)).when(n % 17 == 1, F.lit("  ")).otherwise(F.col("meter")).alias("meter"),
        F.format_string("part-%d.csv", n % 3).alias("_file"), "timestamp", "voltage", "active_power")
    return S.reject_counts(S.split_rejects(S.normalise(raw, meter_id="meter", reasons=True))[1])


_LINE = "meter || ',' || stamp || ',' || volt"


@register("malformed_rows", f"""WITH {RAW_METER_SQL},{RAW_LINES_SQL}
SELECT 'malformed' AS reason, CASE event_id % 9 WHEN 0 THEN {_LINE} || ',' || watt || ',x,y' ELSE {_LINE} END AS record,
       NULL AS meter_id, NULL AS ts, NULL AS voltage, NULL AS active_power FROM cells WHERE event_id % 9 < 2
UNION ALL
SELECT 'good', NULL, CAST(user_id % 10 AS VARCHAR),
       strftime(CASE WHEN event_id % 8 = 5 THEN date_trunc('minute', ts) ELSE date_trunc('second', ts) END, '{TS_SQL}'),
       CASE WHEN event_id % 11 > 3 THEN CAST(190 + (event_id * 37) % 61 AS DOUBLE) END,
       CASE WHEN event_id % 13 <> 5 THEN CAST(floor(value * 100) AS DOUBLE) END
FROM events WHERE event_id % 9 > 1 AND event_id % 8 > 1""")
def malformed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV lines with too many or too few cells, whole, and the good readings beside them."""
    folder = _folder(spark, "csv-lines")
    # no cell separator on writing: a line is written as it is
    raw_meter_lines(spark, sf_dir).write.option("header", True).option("sep", "\u0001").option("quote", "\u0002").csv(folder)
    x = S.normalise(S.read_meter_raw(spark, folder), meter_id="meter", reasons=True)
    good, rejects = S.split_rejects(x)
    cols = ["meter_id", "ts", "voltage", "active_power"]
    bad = rejects.where("reason = 'malformed'").select("reason", "record", *[F.lit(None).cast(x.schema[c].dataType).alias(c) for c in cols])
    return bad.unionByName(good.select(F.lit("good").alias("reason"), F.lit(None).cast("string").alias("record"), *cols))


@register("formats_by_suffix", f"WITH {RAW_METER_SQL}\n{_READINGS} WHERE ts IS NOT NULL")
def formats_by_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same readings from tables in four formats, each told by its path's suffix."""
    folder, text = _folder(spark, "formats"), _text(spark, sf_dir)
    kinds = ("csv", "json", "parquet", "orc")
    for i, kind in enumerate(kinds):
        text.where(F.col("meter").cast("int") % len(kinds) == i).write.format(kind).option("header", True).save(f"{folder}/m.{kind}")
    frames = [S.read_meter(spark, f"{folder}/m.{kind}", fmt=None, meter_id="meter").select(*COLUMNS) for kind in kinds]
    return rounded(reduce(DataFrame.unionByName, frames), 6, "energy")


@register("readings_rewrite", with_mr("""SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS date, count(*) AS rows, count(*) FILTER (WHERE renewed) AS renewed,
       round_even(sum(CASE WHEN renewed THEN 2 * voltage ELSE voltage END), 2) AS voltage,
       max(CASE WHEN renewed THEN 1 ELSE 0 END) AS commits
FROM (SELECT *, CAST(ts AS DATE) IN (SELECT min(CAST(ts AS DATE)) FROM meter_readings) AND voltage > 200 AS renewed,
             CAST(ts AS DATE) IN (SELECT min(CAST(ts AS DATE)) FROM meter_readings) AS late FROM meter_readings)
WHERE renewed OR NOT late GROUP BY 1"""))
def readings_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A readings table whose first day is run again with other rows; all other days stay."""
    path, m = f"{_folder(spark, 'table')}/readings", meter_readings(spark, sf_dir)
    write_readings(m, path)
    table = spark.read.parquet(path)
    day = table.agg(F.min("date")).first()[0]
    again = table.where(F.col("date") == day).where("voltage > 200").drop("date").withColumn("voltage", F.col("voltage") * 2)
    # the new rows are read from the table they replace: written elsewhere first
    again.write.parquet(f"{path}-again")
    rewrite_days(spark.read.parquet(f"{path}-again"), path, [day])
    marks = committed_days(spark, path).select("date", F.lit(1).cast("int").alias("mark"))
    days = spark.read.parquet(path).groupBy("date").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("voltage") > 260).alias("renewed"),
                                                        r(F.sum("voltage")).alias("voltage"))
    return days.join(marks, "date", "left").select(F.col("date").cast("string").alias("date"), "rows", "renewed", "voltage",
                                                   F.coalesce("mark", F.lit(0)).alias("commits"))
