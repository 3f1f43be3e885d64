"""Consumption analytics (F1-F8).

Two-level aggregates: readings -> (meter, day) or (meter, hour) -> meter. Both
levels use partial (map-side) aggregation, so a hot meter costs one combined
row per task before the shuffle. Rounding happens *between* the levels where
the reference rounds before it summarises (daily totals, hour totals).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.functions.calendar import date_of, hour_of, is_weekend, weekday_label, weekday_of
from meterlake.functions.numeric import div, r

K = "meter_id"


def _energy_sum():
    # a group whose energy is all missing sums to 0, as in pandas
    return F.coalesce(F.sum("energy"), F.lit(0.0))


def daily_totals(m: DataFrame) -> DataFrame:
    """Unrounded energy per (meter, date) with weekday flags."""
    return (m.where(F.col("ts").isNotNull())
            .groupBy(K, date_of("ts").alias("date"))
            .agg(_energy_sum().alias("total_energy"))
            .withColumn("weekday", weekday_of(F.col("date")))
            .withColumn("is_weekend", is_weekend(F.col("date"))))


def daily_stats(m: DataFrame) -> DataFrame:
    """per (meter, date) energy sum and power / voltage / current stats, 2 dp."""
    return (m.where(F.col("ts").isNotNull())
            .groupBy(K, date_of("ts").alias("date"))
            .agg(r(_energy_sum()).alias("total_energy"),
                 r(F.avg("active_power")).alias("avg_power"),
                 r(F.max("active_power")).alias("max_power"),
                 r(F.min("active_power")).alias("min_power"),
                 r(F.avg("voltage")).alias("avg_voltage"),
                 r(F.avg("current")).alias("avg_current")))


def daily_summary(m: DataFrame) -> DataFrame:
    """F2 + F3: summary over the *rounded* daily totals; highest / lowest day is
    the earliest date among ties."""
    d = daily_stats(m)
    day = F.unix_date("date")
    return d.groupBy(K).agg(
        F.count(F.lit(1)).alias("total_days"),
        r(F.avg("total_energy")).alias("avg_daily_energy"),
        r(F.max("total_energy")).alias("max_daily_energy"),
        r(F.min("total_energy")).alias("min_daily_energy"),
        r(F.stddev_samp("total_energy")).alias("energy_variance"),
        r(F.sum("total_energy")).alias("total_energy"),
        F.max_by("date", F.struct(F.col("total_energy"), -day)).alias("max_day"),
        F.min_by("date", F.struct(F.col("total_energy"), day)).alias("min_day"),
    )


def hourly_profile(m: DataFrame) -> DataFrame:
    """F4 (and E5): per (meter, hour) energy and power stats, 2 dp."""
    return (m.where(F.col("ts").isNotNull())
            .groupBy(K, hour_of("ts").cast("long").alias("hour"))
            .agg(r(_energy_sum()).alias("total_energy"),
                 r(F.avg("active_power")).alias("avg_power"),
                 r(F.max("active_power")).alias("max_power"),
                 r(F.stddev_samp("active_power")).alias("power_std"),
                 r(F.avg("voltage")).alias("avg_voltage"),
                 r(F.avg("current")).alias("avg_current")))


def peak_valley_hours(m: DataFrame, peak_q: float = 0.8, valley_q: float = 0.2) -> DataFrame:
    """hours whose rounded total is >= the exact q0.8 (peak) or <= q0.2
    (valley) of the meter's hour totals, listed in ascending hour. At most 24
    values per meter, so the exact percentile and the hour list are bounded."""
    h = hourly_profile(m)
    g = h.groupBy(K).agg(
        F.percentile("total_energy", peak_q).alias("pt"),
        F.percentile("total_energy", valley_q).alias("vt"),
        F.array_sort(F.collect_list(F.struct("hour", "total_energy"))).alias("hs"))
    peaks, valleys = peak_and_valley("hs", "pt", "vt")
    as_list = hour_list
    return g.select(K, r("pt").alias("peak_threshold"), r("vt").alias("valley_threshold"),
                    as_list(peaks).alias("peak_hours"), as_list(valleys).alias("valley_hours"),
                    F.size(peaks).cast("long").alias("n_peak_hours"),
                    F.size(valleys).cast("long").alias("n_valley_hours"))


def peak_and_valley(hours: str, peak: str, valley: str):
    """Hours of an array of (hour, total_energy) at or above the peak, and at or below the valley threshold."""
    return (F.filter(hours, lambda x: x["total_energy"] >= F.col(peak)),
            F.filter(hours, lambda x: x["total_energy"] <= F.col(valley)))


def hour_list(hours):
    return F.array_join(F.transform(hours, lambda x: x["hour"].cast("string")), ",")


def peak_valley_ratio(m: DataFrame) -> DataFrame:
    """max hour total / max(0.001, min hour total), 2 dp."""
    h = hourly_profile(m)
    return h.groupBy(K).agg(
        r(F.max("total_energy") / F.greatest(F.lit(0.001), F.min("total_energy"))).alias("peak_valley_ratio"))


def weekday_breakdown(m: DataFrame) -> DataFrame:
    """mean / sample std / sum of the daily totals per weekday (Mon = 0)."""
    d = daily_totals(m)
    return (d.groupBy(K, F.col("weekday").cast("long").alias("weekday"))
            .agg(r(F.avg("total_energy")).alias("mean_energy"),
                 r(F.stddev_samp("total_energy")).alias("std_energy"),
                 r(F.sum("total_energy")).alias("sum_energy"))
            .withColumn("day", weekday_label(F.col("weekday"), "en")))


def weekday_weekend(m: DataFrame) -> DataFrame:
    """F8: mean daily total on weekdays vs weekend days, difference and percent."""
    d = daily_totals(m)
    g = d.groupBy(K).agg(
        F.avg(F.when(~F.col("is_weekend"), F.col("total_energy"))).alias("wd"),
        F.avg(F.when(F.col("is_weekend"), F.col("total_energy"))).alias("we"))
    return g.select(K, r("wd").alias("weekday_avg"), r("we").alias("weekend_avg"),
                    r(F.col("we") - F.col("wd")).alias("difference"),
                    r(div(F.col("we") - F.col("wd"), F.col("wd")) * 100.0, 1).alias("difference_percent"))
