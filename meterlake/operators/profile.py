"""Profile / data quality (B1-B3) and power quality.

Each is one aggregation pass with conditional aggregates (partial + final hash
aggregate); long forms are produced with ``inline`` on the one-row-per-meter
result, never by re-scanning the readings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake import dims
from meterlake.functions.numeric import pct, r
from meterlake.schema import TIME_FORMAT

K = "meter_id"
PROFILE_COLUMNS = ["voltage", "current", "active_power"]


def data_range(m: DataFrame) -> DataFrame:
    """B1: first / last time, row count and the nominal interval's label per meter."""
    return m.groupBy(K).agg(
        F.date_format(F.min("ts"), TIME_FORMAT).alias("start"),
        F.date_format(F.max("ts"), TIME_FORMAT).alias("end"),
        F.count(F.lit(1)).alias("total_records"), F.lit(dims.INTERVAL_LABEL).alias("time_interval"))


def profile_stats(m: DataFrame, columns=PROFILE_COLUMNS) -> DataFrame:
    """B2: mean / sample std / min / max (2 dp) per meter and column, long form."""
    aggs = []
    for c in columns:
        aggs += [r(F.avg(c)).alias(f"{c}__mean"), r(F.stddev_samp(c)).alias(f"{c}__std"),
                 r(F.min(c)).alias(f"{c}__min"), r(F.max(c)).alias(f"{c}__max")]
    wide = m.groupBy(K).agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"{c}__{s}").alias(s)
                                                          for s in ("mean", "std", "min", "max")])
                     for c in columns])
    return wide.select(K, F.inline(rows))


def null_counts(m: DataFrame) -> DataFrame:
    """Missing values per meter and column (NaN was already turned into NULL)."""
    cols = [c for c in m.columns if c != K]
    wide = m.groupBy(K).agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("missing")) for c in cols])
    return wide.select(K, F.inline(rows))


def power_quality(m: DataFrame) -> DataFrame:
    """Voltage, current, power factor and power statistics with verdicts."""
    n = F.count(F.lit(1))
    out = F.count_if((F.col("voltage") < dims.V_MIN) | (F.col("voltage") > dims.V_MAX))
    low = F.count_if(F.col("power_factor") < dims.LOW_PF)
    g = m.groupBy(K).agg(
        r(F.avg("voltage")).alias("voltage_mean"), r(F.stddev_samp("voltage")).alias("voltage_std"),
        r(F.min("voltage")).alias("voltage_min"), r(F.max("voltage")).alias("voltage_max"),
        out.alias("out_of_range_count"), pct(out, n).alias("out_of_range_percent"),
        r(F.avg("current")).alias("current_mean"), r(F.max("current")).alias("current_max"),
        r(F.stddev_samp("current")).alias("current_std"),
        r(F.avg("power_factor"), 3).alias("pf_mean"), r(F.min("power_factor"), 3).alias("pf_min"),
        low.alias("low_pf_count"), pct(low, n).alias("low_pf_percent"),
        r(F.avg("active_power")).alias("power_mean"), r(F.stddev_samp("active_power")).alias("power_std"),
        r(F.min("active_power")).alias("power_min"), r(F.max("active_power")).alias("power_max"))
    return g.select("*", *verdicts())


def verdicts():
    """Voltage and power factor in words."""
    return [F.when(F.col("out_of_range_percent") < 5, F.lit("good")).otherwise(F.lit("attention")).alias("voltage_stability"),
            F.when(F.col("low_pf_percent") < 10, F.lit("good")).otherwise(F.lit("improve")).alias("pf_assessment")]
