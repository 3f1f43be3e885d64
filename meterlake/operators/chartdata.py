"""The tables behind the charts (K1-K8); drawing itself is left to the caller.

Per-meter windows here only run over small, bounded groups (at most ``n``
tail rows, the days or the 24 hours of a meter, 50 histogram bins); the raw
readings are only touched by partial aggregations, joins against one row per
meter, or the chunked ``sequential`` plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterlake.functions.calendar import date_of, hour_of, period_label, period_of
from meterlake.functions.numeric import r
from meterlake.plans.ordered import join_stats, null_safe_join, sequential, top_n_per_group

K = "meter_id"


def _P():
    return F.col("active_power")



def trend_tail(m: DataFrame, n: int = 200) -> DataFrame:
    """K1: the last ``n`` readings of each meter (a per-group limit, planned as
    WindowGroupLimit) with the mean power of that slice."""
    t = top_n_per_group(m, K, [F.col("ts").desc(), F.col("seq").desc()], n, "tail_rank")
    w = Window.partitionBy(K)
    mean = F.avg("active_power").over(w)
    return t.select(K, "seq", "ts", "active_power", "voltage", "current",
                    F.col("tail_rank").cast("long").alias("tail_rank"), r(mean).alias("tail_mean_power"))


def daily_bars(m: DataFrame) -> DataFrame:
    """K2: energy per day (unrounded for the marks), the meter's average line
    and total, and the highest / lowest day (earliest on ties)."""
    d = (m.where(F.col("ts").isNotNull()).groupBy(K, date_of("ts").alias("date"))
         .agg(F.coalesce(F.sum("energy"), F.lit(0.0)).alias("e")))
    w = Window.partitionBy(K)
    hi = Window.partitionBy(K).orderBy(F.col("e").desc(), F.col("date"))
    lo = Window.partitionBy(K).orderBy(F.col("e"), F.col("date"))
    return d.select(K, "date", r("e").alias("total_energy"), r(F.avg("e").over(w)).alias("average_energy"),
                    r(F.sum("e").over(w)).alias("meter_total"),
                    (F.row_number().over(hi) == 1).alias("is_max"), (F.row_number().over(lo) == 1).alias("is_min"))


def hourly_curve(m: DataFrame) -> DataFrame:
    """K3: per hour mean / std / min / max power and energy, the mean +/- 1 std
    band and the peak / valley hour by mean power."""
    h = (m.where(F.col("ts").isNotNull()).groupBy(K, hour_of("ts").cast("long").alias("hour"))
         .agg(F.avg(_P()).alias("a"), F.stddev_samp(_P()).alias("s"), F.min(_P()).alias("mn"), F.max(_P()).alias("mx"),
              F.coalesce(F.sum("energy"), F.lit(0.0)).alias("e")))
    hi = Window.partitionBy(K).orderBy(F.col("a").desc(), F.col("hour"))
    lo = Window.partitionBy(K).orderBy(F.col("a"), F.col("hour"))
    return h.select(K, "hour", r("a").alias("avg_power"), r("s").alias("power_std"), r("mn").alias("min_power"),
                    r("mx").alias("max_power"), r("e").alias("total_energy"),
                    r(F.col("a") - F.col("s")).alias("band_low"), r(F.col("a") + F.col("s")).alias("band_high"),
                    (F.row_number().over(hi) == 1).alias("is_peak"), (F.row_number().over(lo) == 1).alias("is_valley"))


def period_share(m: DataFrame) -> DataFrame:
    """K4: each day period's share of the meter's energy, in percent."""
    p = (m.where(F.col("ts").isNotNull()).groupBy(K, period_of(hour_of("ts")).alias("period"))
         .agg(F.coalesce(F.sum("energy"), F.lit(0.0)).alias("e")))
    total = F.sum("e").over(Window.partitionBy(K))
    return p.select(K, "period", period_label(F.col("period"), "chart").alias("period_label"),
                    r("e", 4).alias("total_energy"), r(F.col("e") / total * 100.0, 1).alias("share_percent"))


def histogram(m: DataFrame, col: str, bins: int) -> DataFrame:
    """K5 / K6: ``bins`` equal-width bins from the meter's min to max (last bin
    closed; min = max widens to +/- 0.5 like numpy), every bin listed."""
    s = m.groupBy(K).agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"))
    s = s.select(K, F.when(F.col("_lo") == F.col("_hi"), F.col("_lo") - 0.5).otherwise(F.col("_lo")).alias("lo"),
                 F.when(F.col("_lo") == F.col("_hi"), F.col("_hi") + 0.5).otherwise(F.col("_hi")).alias("hi"))
    x = join_stats(m.select(K, "ts", col).where(F.col(col).isNotNull()), s)
    b = F.least(F.floor((F.col(col) - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))), F.lit(bins - 1)) + 1
    counts = x.groupBy(K, b.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    grid = s.select(K, "lo", "hi", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    grid = grid.withColumn("bin", F.col("bin").cast("long"))
    width = (F.col("hi") - F.col("lo")) / bins
    return null_safe_join(grid, counts, [K, "bin"], "left").select(
        K, "bin", r(F.col("lo") + (F.col("bin") - 1) * width, 4).alias("bin_start"),
        r(F.col("lo") + F.col("bin") * width, 4).alias("bin_end"),
        F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count"))


def voltage_histogram(m: DataFrame, bins: int = 50) -> DataFrame:
    return histogram(m, "voltage", bins)


def pf_histogram(m: DataFrame, bins: int = 30) -> DataFrame:
    return histogram(m, "power_factor", bins)


def quality_scatter(m: DataFrame, fraction: float | None = None, seed: int = 42) -> DataFrame:
    """K7: active vs reactive power coloured by power factor; ``fraction``
    draws a Bernoulli sample for very large meters."""
    x = m.select(K, "seq", "ts", "active_power", "reactive_power", "power_factor")
    return x.sample(fraction=fraction, seed=seed) if fraction else x


def every_nth(m: DataFrame, n: int = 10, chunk: str | None = "auto") -> DataFrame:
    """K8: rows 0, n, 2n, ... of each meter in time order (systematic sample)."""
    x = sequential(m.select(K, "seq", "ts", "power_factor"), row_number="_rn", chunk=chunk)
    return x.where((F.col("_rn") - 1) % n == 0).select(K, "seq", "ts", "power_factor",
                                                       (F.col("_rn") - 1).cast("long").alias("position"))
