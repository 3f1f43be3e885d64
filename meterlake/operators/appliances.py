"""Appliance identification and usage.

The catalogue has ten rows, so band matching is a broadcast nested-loop join
against a fixed, proven-small dimension; each input row meets at most ten
catalogue rows and the top three are kept with ``row_number`` per input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterlake import dims
from meterlake.functions.calendar import hour_label, hour_of
from meterlake.functions.numeric import pct, r
from meterlake.operators.segments import segments as _segments
from meterlake.plans.ordered import top_n_per_group

K = "meter_id"


def _dim(df: DataFrame) -> DataFrame:
    return dims.appliance_df(df.sparkSession)


def _band():
    return F.concat(F.col("p_lo").cast("string"), F.lit("-"), F.col("p_hi").cast("string"), F.lit("W"))


def match_by_power(requests: DataFrame, power: str = "power", top: int = 3, keys=None) -> DataFrame:
    """Appliances whose band holds ``power`` (inclusive); confidence
    ``round((0.6 + 0.4 * (p - lo) / (hi - lo)) * 100, 1)``; best ``top`` by
    confidence, catalogue order on ties. ``keys`` identify a request (default
    the power value itself)."""
    keys = list(keys or [power])
    p = F.col(power)
    j = requests.join(_dim(requests), (p >= F.col("p_lo")) & (p <= F.col("p_hi")))
    conf = r((F.lit(0.6) + F.lit(0.4) * ((p - F.col("p_lo")) / (F.col("p_hi") - F.col("p_lo")))) * 100.0, 1)
    j = j.select(*keys, "appliance", "appliance_name", "ord", conf.alias("confidence"),
                 _band().alias("power_match"), "characteristics", "usage_pattern")
    ranked = top_n_per_group(j, keys, [F.col("confidence").desc(), F.col("ord")], top)
    return ranked.select(*keys, F.col("rank").cast("long").alias("rank"), "appliance", "appliance_name",
                         "confidence", "power_match", "characteristics", "usage_pattern")


def distinct_powers(m: DataFrame) -> DataFrame:
    """Identification requests for every distinct power value of the readings
    (pre-aggregated: a popular value is matched once)."""
    return m.where(F.col("active_power").isNotNull()).select(F.col("active_power").alias("power")).distinct()


def match_by_segment(segs: DataFrame, top: int = 3) -> DataFrame:
    """Power band (inclusive) -> 50, +30 when the duration is in the typical
    range, +10 when the opening step exceeded 100 W, capped at 95."""
    p, d = F.col("avg_power"), F.col("duration_minutes")
    j = segs.join(_dim(segs), (p >= F.col("p_lo")) & (p <= F.col("p_hi")))
    score = (F.lit(50)
             + F.when((d >= F.col("d_lo")) & (d <= F.col("d_hi")), 30).otherwise(0)
             + F.when(F.col("power_change") > 100, 10).otherwise(0))
    j = j.select(K, "segment_id", "appliance", "appliance_name", "ord",
                 F.least(score, F.lit(95)).cast("long").alias("confidence"), "avg_power",
                 F.col("duration_minutes").alias("duration"), _band().alias("power_range"), "characteristics",
                 "usage_pattern")
    ranked = top_n_per_group(j, [K, "segment_id"], [F.col("confidence").desc(), F.col("ord")], top)
    return ranked.select(K, "segment_id", F.col("rank").cast("long").alias("rank"),
                         "appliance", "appliance_name", "confidence", "avg_power", "duration", "power_range",
                         "characteristics", "usage_pattern")


def segment_matches(m: DataFrame, threshold: float = 50.0, chunk: str | None = "auto") -> DataFrame:
    return match_by_segment(_segments(m, threshold, chunk))


def usage_distribution(m: DataFrame) -> DataFrame:
    """Rows per half-open power bucket and share of *all* rows; empty
    buckets are listed with 0. One pass, five conditional counts, no join."""
    P = F.col("active_power")
    n = F.count(F.lit(1))
    aggs = [n.alias("_n")] + [F.count_if((P >= lo) & (P < hi)).alias(f"_b{i}")
                             for i, _c, _l, lo, hi in dims.USAGE_BUCKETS]
    g = m.groupBy(K).agg(*aggs)
    rows = F.array(*[F.struct(F.lit(i).cast("long").alias("bucket"), F.lit(code).alias("category"),
                              F.lit(f"{lo}-{hi}W").alias("power_range"), F.col(f"_b{i}").alias("count"),
                              pct(F.col(f"_b{i}"), F.col("_n")).alias("percentage"))
                     for i, code, _l, lo, hi in dims.USAGE_BUCKETS])
    return g.select(K, F.inline(rows))


def hourly_mean_power(m: DataFrame) -> DataFrame:
    """E5: unrounded mean power per (meter, hour)."""
    return (m.where(F.col("ts").isNotNull())
            .groupBy(K, hour_of("ts").cast("long").alias("hour"))
            .agg(F.avg("active_power").alias("avg_power")))


def top_hours(m: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` hours with the highest and the lowest mean power (lower
    hour first on ties), with the rounded mean and an ``h:00`` label. Both
    rankings come from one pass over the (at most 24) hour rows per meter."""
    h = hourly_mean_power(m).where(F.col("avg_power").isNotNull())
    w_hi = Window.partitionBy(K).orderBy(F.col("avg_power").desc(), F.col("hour"))
    w_lo = Window.partitionBy(K).orderBy(F.col("avg_power"), F.col("hour"))
    x = h.select("*", F.row_number().over(w_hi).alias("r_hi"), F.row_number().over(w_lo).alias("r_lo"))
    both = F.array(F.struct(F.lit("peak").alias("kind"), F.col("r_hi").alias("rank")),
                   F.struct(F.lit("low").alias("kind"), F.col("r_lo").alias("rank")))
    y = x.select(K, "hour", "avg_power", F.inline(both)).where(F.col("rank") <= n)
    return y.select(K, "kind", F.col("rank").cast("long").alias("rank"), "hour",
                    hour_label(F.col("hour")).alias("hour_label"), r("avg_power").alias("avg_power"))
