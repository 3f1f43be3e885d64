"""Sinks (A5, A6).

Writes are plain DataFrame writers: partitioned parquet / CSV tables for
readings and results, and one JSON document per meter for reports. Output
folders are overwritten as a whole (idempotent re-runs after a failure);
``rewrite_days`` replaces single dates of a readings table.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

from meterlake.functions.calendar import date_of

#: Folder of the commit markers inside a readings table; readers skip names with an underscore.
COMMITS = "_commits"


def write_readings(m: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """A5: readings partitioned by meter-local ``date`` (partition pruning for
    time-range queries), each file sorted by (meter, ts, seq). The rebalance hint lets
    AQE cut a large day into several tasks and files and join small ones."""
    _by_date(m).mode(mode).format(fmt).save(path)


def _by_date(m: DataFrame) -> DataFrameWriter:
    return (m.withColumn("date", date_of("ts"))
            .hint("rebalance", "date")
            .sortWithinPartitions("date", "meter_id", "ts", "seq")
            .write.option("header", True).partitionBy("date"))


def rewrite_days(m: DataFrame, path: str, days=None, fmt: str = "parquet") -> None:
    """A5: replaces the dates of ``m`` (only ``days``, if given) in a readings table and leaves all
    others untouched. The new files of a date become visible when the whole job has ended;
    then each of its dates gets a marker, whose rows tell what was committed. A failed job
    changes neither files nor markers, so the same days can simply be run again."""
    m = m.where(F.col("ts").isNotNull())
    if days is not None:
        m = m.where(date_of("ts").isin([d if isinstance(d, date) else date.fromisoformat(d) for d in days]))
    _by_date(m).mode("overwrite").option("partitionOverwriteMode", "dynamic").format(fmt).save(path)
    marks = m.groupBy(date_of("ts").alias("date")).agg(F.count(F.lit(1)).alias("rows"))
    marks.withColumn("committed_at", F.current_timestamp()).write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
        .partitionBy("date").parquet(f"{path}/{COMMITS}")


def committed_days(spark: SparkSession, path: str) -> DataFrame:
    """date, rows, committed_at of the dates that ``rewrite_days`` has replaced."""
    return spark.read.schema("rows long, committed_at timestamp, date date").parquet(f"{path}/{COMMITS}")


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", partition_by=()) -> None:
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def write_json_reports(reports: DataFrame, path: str, column: str = "analysis", mode: str = "overwrite") -> None:
    """One JSON object per line (per meter) from a ``to_json`` column."""
    reports.select(F.col(column).alias("value")).write.mode(mode).text(path)
