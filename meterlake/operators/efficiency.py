"""Efficiency evaluation.

All five standardised appliances are evaluated in one pass over the readings
(conditional aggregates per appliance band, then ``inline`` into five rows per
meter), so a meter where an appliance never runs still gets its
``not_running`` row without any join against a meter list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake import dims
from meterlake.functions.calendar import hour_of, period_label, period_of
from meterlake.functions.numeric import div, r

K = "meter_id"


def _P():
    return F.col("active_power")


NAMES = {c: n for c, n, *_ in dims.APPLIANCES}


def _bands(appliance: str):
    return [(lvl, lo, hi) for a, lvl, _m, _v, lo, hi in dims.EFFICIENCY_STANDARDS if a == appliance]


def prefilter_range(appliance: str, prefilter: str = "excellent"):
    """Readings attributed to an appliance: [0.8 * lo, 1.2 * hi] of its
    excellent band (reference), or of all its bands (``prefilter='all_levels'``)."""
    bands = _bands(appliance)
    if prefilter == "all_levels":
        lo, hi = min(b[1] for b in bands), max(b[2] for b in bands)
    else:
        lo, hi = bands[0][1], bands[0][2]
    return lo * 0.8, hi * 1.2


def level_of(appliance: str, avg):
    """First level (excellent..poor) whose inclusive band holds ``avg``, else 'unknown'."""
    out = F.lit("unknown")
    for lvl, lo, hi in reversed(_bands(appliance)):
        out = F.when((avg >= lo) & (avg <= hi), F.lit(lvl)).otherwise(out)
    return out


def appliance_efficiency(m: DataFrame, appliances=None, prefilter: str = "excellent",
                         interval_minutes: float = 1.0) -> DataFrame:
    """I2 + I3: per (meter, appliance) average power, energy, daily usage
    (energy / 30), operating hours (rows x interval), level, score and suggestions.
    An appliance without a standard gets a ``no_standard`` row with an error text."""
    appliances = list(appliances or dims.EFFICIENCY_APPLIANCES)
    unlisted = [a for a in appliances if a not in dims.EFFICIENCY_APPLIANCES]
    appliances = [a for a in appliances if a not in unlisted]
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, a in enumerate(appliances):
        lo, hi = prefilter_range(a, prefilter)
        inb = (_P() >= lo) & (_P() <= hi)
        aggs += [F.count_if(inb).alias(f"n{i}"), F.avg(F.when(inb, _P())).alias(f"p{i}"),
                 F.coalesce(F.sum(F.when(inb, F.col("energy"))), F.lit(0.0)).alias(f"e{i}"),
                 level_of(a, F.avg(F.when(inb, _P()))).alias(f"l{i}")]
    g = m.groupBy(K).agg(*aggs)
    rows = F.array(*[F.struct(F.lit(a).alias("appliance"), F.lit(NAMES[a]).alias("appliance_name"),
                              F.col(f"n{i}").alias("n"), F.col(f"p{i}").alias("p"),
                              F.col(f"e{i}").alias("e"), F.col(f"l{i}").alias("lvl"),
                              F.lit(None).cast("string").alias("error"))
                     for i, a in enumerate(appliances)],
                   *[F.struct(F.lit(a).alias("appliance"), F.lit(NAMES.get(a, a)).alias("appliance_name"),
                              F.lit(None).cast("long").alias("n"), F.lit(None).cast("double").alias("p"),
                              F.lit(None).cast("double").alias("e"), F.lit(None).cast("string").alias("lvl"),
                              F.lit(dims.NO_STANDARD_TEXT % NAMES.get(a, a)).alias("error"))
                     for a in unlisted])
    x = g.select(K, F.inline(rows))
    running = F.col("n") > 0
    score = F.coalesce(F.create_map(*[v for k, s in dims.LEVEL_SCORES.items() for v in (F.lit(k), F.lit(s))])
                       [F.col("lvl")], F.lit(0))
    sugg = F.create_map(*[v for k, s in dims.LEVEL_SUGGESTIONS.items() for v in (F.lit(k), F.lit(" | ".join(s)))])
    on = lambda c: F.when(running, c)
    return x.select(
        K, "appliance", "appliance_name",
        F.when(running, F.lit("running")).when(F.col("error").isNotNull(), F.lit("no_standard"))
         .otherwise(F.lit("not_running")).alias("status"),
        on(F.col("lvl")).alias("efficiency_level"), on(score).cast("double").alias("efficiency_score"),
        on(r("p")).alias("avg_power"), on(r("e")).alias("total_energy"),
        on(r(F.col("e") / 30.0)).alias("estimated_daily_usage"),
        on(r(F.col("n") * float(interval_minutes) / 60.0, 1)).alias("operating_hours"),
        on(F.coalesce(sugg[F.col("lvl")], F.lit(""))).alias("suggestions"), "error")


def overall_efficiency(m: DataFrame, calibrated: bool = False) -> DataFrame:
    """I4-I6 + I9. ``calibrated=False`` reproduces the reference score (kWh
    divided by W*h and an extra x100, so almost every meter clamps to 100 and a
    meter with no reading below 100 W scores 0); ``calibrated=True`` converts
    kWh to Wh and drops the extra x100."""
    g = m.groupBy(K).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("energy"), F.lit(0.0)).alias("te"),
        F.avg(_P()).alias("avg"), F.max(_P()).alias("peak"), F.avg(F.when(_P() < 100, _P())).alias("base"))
    avg, n, peak = F.col("avg"), F.col("n"), F.col("peak")
    energy = F.col("te") * 1000.0 if calibrated else F.col("te")
    eu = F.when(avg > 0, div(energy, avg * n / 60.0)).otherwise(F.lit(0.0))
    lf = F.when(peak > 0, div(avg, peak)).otherwise(F.lit(0.0))
    blr = F.when(avg > 0, div(F.col("base"), avg)).otherwise(F.lit(0.0))
    x = g.select("*", eu.alias("eu"), lf.alias("lf"), blr.alias("blr"))
    raw = F.col("eu") * 40 + F.col("lf") * 35 + (F.lit(1) - F.col("blr")) * 25
    if not calibrated:
        raw = raw * 100
    x = x.withColumn("raw", raw).withColumn("score", F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.col("raw"))))
    s = F.col("score")
    level = F.when(s >= 85, F.lit("excellent")).when(s >= 70, F.lit("good")).when(s >= 55, F.lit("fair")) \
        .otherwise(F.lit("poor"))
    rules = F.concat(
        F.when(F.coalesce(F.col("lf") < 0.5, F.lit(False)), F.array(F.lit("low_load_factor"))).otherwise(F.array()),
        F.when(F.coalesce(F.col("blr") > 0.3, F.lit(False)), F.array(F.lit("high_base_load"))).otherwise(F.array()),
        F.when(F.coalesce(peak > avg * 3, F.lit(False)), F.array(F.lit("high_peak"))).otherwise(F.array()))
    rules = F.when(F.size(rules) == 0, F.array(F.lit("ok"))).otherwise(rules)
    words = F.create_map(*[F.lit(x) for code, texts in dims.IMPROVEMENT_RULES for x in (code, " | ".join(texts))])
    labels = F.create_map(*[F.lit(x) for code, _cut, text in dims.OVERALL_LEVELS for x in (code, text)])
    color = F.when(s >= 85, F.lit("green")).when(s >= 70, F.lit("amber")).otherwise(F.lit("red"))
    return x.select(
        K, r("score", 1).alias("overall_score"), r("raw", 1).alias("raw_score"), level.alias("efficiency_level"),
        labels[level].alias("level_description"), r("eu", 3).alias("energy_utilization"), r("lf", 3).alias("load_factor"),
        r("blr", 3).alias("base_load_ratio"), r("avg").alias("average_power"), r("peak").alias("peak_power"),
        F.coalesce(r("base"), F.lit(0.0)).alias("base_load"), r("te").alias("total_energy"),
        F.array_join(rules, ",").alias("suggestions"),
        F.array_join(F.transform(rules, lambda c: words[c]), " | ").alias("improvement_suggestions"), color.alias("gauge_color"))


def period_efficiency(m: DataFrame) -> DataFrame:
    """Per (meter, day period) rounded stats, then a score from the
    *rounded* values: 100 - (0.9 - pf) * 50 when pf < 0.9, -10 when
    std > 0.5 * mean, floored at 0."""
    g = (m.where(F.col("ts").isNotNull())
         .groupBy(K, period_of(hour_of("ts")).alias("period"))
         .agg(r(F.avg(_P())).alias("avg_power"), r(F.stddev_samp(_P())).alias("power_std"),
              r(F.max(_P())).alias("peak_power"), r(F.coalesce(F.sum("energy"), F.lit(0.0))).alias("total_energy"),
              r(F.avg("power_factor")).alias("avg_power_factor")))
    pf, sd, av = F.col("avg_power_factor"), F.col("power_std"), F.col("avg_power")
    score = (F.lit(100.0) - F.when(pf < 0.9, (F.lit(0.9) - pf) * 50).otherwise(F.lit(0.0))
             - F.when(sd > av * 0.5, F.lit(10.0)).otherwise(F.lit(0.0)))
    return g.select(K, "period", period_label(F.col("period")).alias("period_label"), "avg_power", "power_std",
                    "peak_power", "total_energy", "avg_power_factor",
                    F.greatest(F.lit(0.0), r(score, 1)).alias("efficiency_score"))


def best_worst_period(m: DataFrame) -> DataFrame:
    """I8: lowest / highest mean-power period and the advice for each; ties go to the period the
    reference lists first (its label order)."""
    p = period_efficiency(m)
    tie = F.create_map(*[v for k, i in dims.PERIOD_TIE_ORDER.items() for v in (F.lit(k), F.lit(i))])[F.col("period")]
    rec = F.struct("period", "avg_power", "efficiency_score")
    g = p.groupBy(K).agg(F.min_by(rec, F.struct(F.col("avg_power"), tie)).alias("b"),
                         F.max_by(rec, F.struct(F.col("avg_power"), -tie)).alias("w"))
    return g.select(K, F.col("b.period").alias("best_period"), F.col("b.avg_power").alias("best_avg_power"),
                    F.col("b.efficiency_score").alias("best_score"), F.col("w.period").alias("worst_period"),
                    F.col("w.avg_power").alias("worst_avg_power"), F.col("w.efficiency_score").alias("worst_score"),
                    F.format_string(dims.BEST_PERIOD_TEXT, period_label(F.col("b.period"))).alias("best_recommendation"),
                    F.format_string(dims.WORST_PERIOD_TEXT, period_label(F.col("w.period"))).alias("worst_recommendation"))
