"""Anomaly detection and alerting.

Statistics-then-filter: the per-meter mean / std is one small aggregate that
is joined back to the readings on (meter, chunk) by ``join_stats``, so a hot
meter is spread over its chunks whatever join Spark picks. No per-meter window
over raw readings is used; steps come from the chunked ``sequential`` plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlake import dims
from meterlake.functions.calendar import date_of, is_weekend
from meterlake.functions.numeric import div, pct, r
from meterlake.operators.consumption import daily_totals
from meterlake.operators.segments import power_steps
from meterlake.plans.cells import about_mean, moments, std_samp
from meterlake.plans.ordered import ORDER, cell_columns, join_stats, locate, meter_columns, order_key, resolve_chunk, rolling
from meterlake.plans.quantiles import exact_quantile

K = "meter_id"


def _V():
    return F.col("voltage")


def voltage_stats(m: DataFrame) -> DataFrame:
    return m.groupBy(K).agg(F.count(F.lit(1)).alias("n"), F.avg("voltage").alias("v_mean"),
                            F.stddev_samp("voltage").alias("v_std"))


def _with_voltage_flags(m: DataFrame, std_threshold: float) -> DataFrame:
    return join_stats(m, voltage_stats(m)).select("*", *_flags(std_threshold))


def _flags(std_threshold: float) -> list:
    """Flags of a reading that carries its meter's ``v_mean`` and ``v_std``."""
    lo = F.col("v_mean") - std_threshold * F.col("v_std")
    hi = F.col("v_mean") + std_threshold * F.col("v_std")
    return [
        ((_V() < dims.V_MIN) | (_V() > dims.V_MAX)).alias("is_out_of_range"),
        (_V() < dims.V_MIN).alias("is_low"), (_V() > dims.V_MAX).alias("is_high"),
        ((_V() < lo) | (_V() > hi)).alias("is_outlier"),
        ((_V() < F.col("v_mean") * 0.9) & (_V() >= dims.V_MIN)).alias("is_sag"),
        ((_V() > F.col("v_mean") * 1.1) & (_V() <= dims.V_MAX)).alias("is_swell")]


def _flag_counts() -> list:
    return [F.count_if("is_out_of_range").alias("out_of_range_count"),
            F.count_if("is_low").alias("low_count"), F.count_if("is_high").alias("high_count"),
            F.count_if("is_outlier").alias("outlier_count"),
            F.count_if("is_sag").alias("sag_count"), F.count_if("is_swell").alias("swell_count")]


def voltage_flags(m: DataFrame, std_threshold: float = 3.0) -> DataFrame:
    """H1-H6 per meter: out-of-range / low / high / statistical outlier / sag /
    swell counts, shares, severity of the out-of-range anomaly and status."""
    x = _with_voltage_flags(m, std_threshold)
    n = F.first("n")
    g = x.groupBy(K).agg(
        n.alias("n"),
        r(F.first("v_mean")).alias("voltage_mean"), r(F.first("v_std")).alias("voltage_std"),
        r(F.min("voltage")).alias("voltage_min"), r(F.max("voltage")).alias("voltage_max"), *_flag_counts())
    return g.select(K, *_voltage_columns())


def _voltage_columns() -> list:
    """H1-H6 in one row: shares, severity and status from the counts."""
    share = div(F.col("out_of_range_count").cast("double"), F.col("n"))
    return [
        F.col("n").alias("total_records"), "voltage_mean", "voltage_std", "voltage_min", "voltage_max",
        "out_of_range_count", pct("out_of_range_count", "n").alias("out_of_range_percent"),
        F.when(share > 0.05, F.lit("high")).otherwise(F.lit("medium")).alias("out_of_range_severity"),
        "low_count", "high_count", "outlier_count",
        "sag_count", pct("sag_count", "n").alias("sag_percent"),
        "swell_count", pct("swell_count", "n").alias("swell_percent"),
        F.when(share < 0.01, F.lit("normal")).otherwise(F.lit("attention")).alias("voltage_status")]


def voltage_outliers(m: DataFrame, std_threshold: float = 3.0) -> DataFrame:
    """H3: statistical outliers outside mean +/- k * std, per meter."""
    s = voltage_stats(m)
    x = join_stats(m, s)
    lo = F.col("v_mean") - std_threshold * F.col("v_std")
    hi = F.col("v_mean") + std_threshold * F.col("v_std")
    return x.groupBy(K).agg(
        r(F.first(lo)).alias("lower_bound"), r(F.first(hi)).alias("upper_bound"),
        F.count_if((_V() < lo) | (_V() > hi)).alias("outlier_count"),
        F.count_if(_V() < lo).alias("below_count"), F.count_if(_V() > hi).alias("above_count"))


def voltage_samples(m: DataFrame, std_threshold: float = 3.0, n_out: int = 5, n_sag: int = 3) -> DataFrame:
    """First readings (time order) of each voltage anomaly: 5 out-of-range, 3
    sags, 3 swells. Flags are computed once, each flagged reading is fanned out
    to its anomaly types, then a per-(meter, type) limit keeps the first ones."""
    x = _with_voltage_flags(m, std_threshold)
    kinds = F.array(F.when(F.col("is_out_of_range"), F.lit("voltage_out_of_range")),
                    F.when(F.col("is_sag"), F.lit("voltage_sag")), F.when(F.col("is_swell"), F.lit("voltage_swell")))
    u = (x.where(F.col("is_out_of_range") | F.col("is_sag") | F.col("is_swell"))
         .select(K, "ts", "seq", "voltage", F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("type")))
    k = F.when(F.col("type") == "voltage_out_of_range", F.lit(n_out)).otherwise(F.lit(n_sag))
    w = Window.partitionBy(K, "type").orderBy("ts", "seq")
    # a literal bound first, so the optimizer plans a per-group limit before the shuffle
    u = (u.withColumn("sample_rank", F.row_number().over(w))
         .where(F.col("sample_rank") <= max(n_out, n_sag)).where(F.col("sample_rank") <= k))
    return u.select(K, "type", F.col("sample_rank").cast("long").alias("sample_rank"), "ts", "voltage")


def power_stats(m: DataFrame, q: float = 0.95, method: str = "selection") -> DataFrame:
    """Per-meter power statistics incl. the exact q0.95 high-power threshold
    (H12). ``method='selection'`` (default) finds the exact percentile with
    bounded memory per meter (plans.quantiles); ``'aggregate'`` uses Spark's
    ``percentile`` (one pass, but it buffers every distinct value of a meter);
    ``'approx'`` uses ``percentile_approx`` (GK sketch, not exact)."""
    P = F.col("active_power")
    base = [F.count(F.lit(1)).alias("n"), F.avg(P).alias("p_mean"), F.stddev_samp(P).alias("p_std"),
            F.min(P).alias("p_min"), F.max(P).alias("p_max")]
    if method == "aggregate":
        return m.groupBy(K).agg(*base, F.percentile(P, q).alias("p_q95"))
    if method == "approx":
        return m.groupBy(K).agg(*base, F.percentile_approx(P, q, 10000).cast("double").alias("p_q95"))
    # the other statistics ride along the quantile's first pass (one scan fewer)
    q95 = exact_quantile(m, K, "active_power", q, out="p_q95", extra_aggs=base, ts="ts")
    return q95.select(K, "n", "p_mean", "p_std", "p_min", "p_max", "p_q95")


def high_power_threshold(m: DataFrame, q: float = 0.95, method: str = "selection") -> DataFrame:
    """q0.95 of power per meter and the readings above it."""
    s = power_stats(m, q, method)
    x = join_stats(m.select(K, "ts", "active_power"), s.select(K, "p_q95"))
    return x.groupBy(K).agg(r(F.first("p_q95")).alias("high_power_threshold"),
                            F.count_if(F.col("active_power") > F.col("p_q95")).alias("above_threshold_count"))


def power_step_anomalies(m: DataFrame, chunk: str | None = "auto") -> DataFrame:
    """H8-H13 per meter: sudden changes |step| > 3 std, spikes step > 5 std,
    drops step < -5 std (std = sample std of the meter's power), counts,
    shares, largest spike / drop, kinds by severity, q0.95 threshold and power status. The
    per-meter statistics ride along the one join with the steps."""
    s = power_stats(m)
    st = power_steps(m.select(K, "seq", "ts", "active_power"), chunk=chunk)
    x = join_stats(st, s, chunk=chunk)
    step, sd = F.col("power_step"), F.col("p_std")
    g = x.groupBy(K).agg(
        *[F.first(c).alias(c) for c in ("n", "p_mean", "p_std", "p_min", "p_max", "p_q95")], *_step_counts(step, sd))
    own, status = _power_columns()[:4], _power_columns()[4:]
    return g.select(K, *own, r("p_q95").alias("high_power_threshold"), *status)


def _step_counts(step: Column, std: Column) -> list:
    """Counts and extremes of steps against the meter's standard deviation."""
    return [F.count_if(F.abs(step) > std * 3).alias("sudden_count"),
            F.count_if(step > std * 5).alias("spike_count"),
            F.count_if(step < -std * 5).alias("drop_count"),
            F.max(F.when(step > std * 5, step)).alias("_max_spike"),
            F.min(F.when(step < -std * 5, step)).alias("_min_drop")]


def _power_columns() -> list:
    """H8-H11, H13 in one row: statistics, shares and status from the counts."""
    return [
        r("p_mean").alias("power_mean"), r("p_std").alias("power_std"),
        r("p_min").alias("power_min"), r("p_max").alias("power_max"),
        "sudden_count", pct("sudden_count", "n").alias("sudden_percent"),
        "spike_count", pct("spike_count", "n").alias("spike_percent"), r("_max_spike").alias("max_spike"),
        "drop_count", pct("drop_count", "n").alias("drop_percent"), r(F.abs("_min_drop")).alias("max_drop"),
        (F.col("spike_count") > 0).cast("long").alias("high_severity_count"),
        ((F.col("sudden_count") > 0).cast("long") + (F.col("drop_count") > 0).cast("long")).alias("medium_severity_count"),
        F.when(F.col("spike_count") > 0, F.lit("abnormal")).otherwise(F.lit("normal")).alias("power_status")]


def rolling_power(m: DataFrame, n: int = 60, chunk: str | None = "auto", block: int | None = None) -> DataFrame:
    """H7: trailing 60-row mean / sample std of power (rows, not time, at least
    one row). Every frame holds the same rows in the same order in both plans, so
    chunked and plain results agree bit for bit."""
    x = rolling(m.select(K, "seq", "ts", "active_power"),
                {"rolling_mean": ("avg", "active_power"), "rolling_std": ("stddev_samp", "active_power")}, n,
                chunk=chunk, block=block)
    return x.select(K, "seq", "ts", "active_power", "rolling_mean", "rolling_std")


def _daily_z(m: DataFrame) -> DataFrame:
    # one row per meter-day: the per-meter window below is bounded by days
    d = daily_totals(m)
    w = Window.partitionBy(K)
    d = d.select("*", F.avg("total_energy").over(w).alias("d_mean"),
                 F.stddev_pop("total_energy").over(w).alias("d_std"))
    z = F.when(F.col("d_std") > 0, (F.col("total_energy") - F.col("d_mean")) / F.col("d_std")).otherwise(F.lit(0.0))
    return d.withColumn("z", z)


def daily_zscore(m: DataFrame, threshold: float = 2.0) -> DataFrame:
    """Days whose energy has |z| > 2 against the meter's daily mean and
    *population* std (0 when the std is 0)."""
    d = _daily_z(m).where(F.abs("z") > threshold)
    return d.select(K, "date", r("total_energy").alias("energy"), r("z").alias("z_score"),
                    F.when(F.col("z") > 0, F.lit("high")).otherwise(F.lit("low")).alias("deviation"))


def consumption_summary(m: DataFrame, z_threshold: float = 2.0, ratio_threshold: float = 1.3) -> DataFrame:
    """H14 + H15 per meter: daily mean / population std, weekday and weekend
    means, weekend:weekday ratio (0 unless the weekday mean is > 0), pattern
    flag, abnormal day count and status (abnormal only for more than one day)."""
    d = _daily_z(m)
    g = d.groupBy(K).agg(
        F.first("d_mean").alias("d_mean"), F.first("d_std").alias("d_std"),
        F.avg(F.when(~F.col("is_weekend"), F.col("total_energy"))).alias("wd"),
        F.avg(F.when(F.col("is_weekend"), F.col("total_energy"))).alias("we"),
        F.count_if(F.abs("z") > z_threshold).alias("abnormal_days"))
    return g.select(K, *_consumption_columns(ratio_threshold))


def _consumption_columns(ratio_threshold: float = 1.3) -> list:
    """H14 + H15 in one row: ratio, pattern flag and status from the daily means and the abnormal days."""
    ratio = F.when(F.col("wd") > 0, F.col("we") / F.col("wd")).otherwise(F.lit(0.0))
    return [
        r("d_mean").alias("daily_mean"), r("d_std").alias("daily_std"),
        r("wd").alias("weekday_avg"), r("we").alias("weekend_avg"), r(ratio).alias("ratio"),
        F.coalesce(ratio > ratio_threshold, F.lit(False)).alias("pattern_anomaly"),
        F.col("abnormal_days"),
        F.when(F.col("abnormal_days") > 1, F.lit("abnormal")).otherwise(F.lit("normal")).alias("consumption_status")]


def anomaly_summary(m: DataFrame, std_threshold: float = 3.0, chunk: str | None = "auto",
                    z_threshold: float = 2.0) -> DataFrame:
    """The three detectors side by side, one row per meter, in two passes over the readings.

    The first one aggregates cells per (meter, chunk): partial moments, the last power and the
    energy; windows over a meter's cells give its statistics, its days and the power before
    each chunk. The second one reads the readings by (meter, chunk), meets their cell's row and
    counts voltage flags and power steps at once."""
    unit = resolve_chunk(m, chunk)
    unit = unit if unit in ("hour", "minute") else "day"  # a chunk lies within a day
    d = locate(m.select(K, "seq", "ts", "voltage", "active_power", "energy"), [K], ORDER, unit)
    cell, meter = cell_columns([K]), meter_columns([K])
    last = F.max_by("active_power", order_key(d, ORDER) if order_key(d, ORDER) is not None else F.struct(*ORDER))
    cells = d.groupBy(*cell).agg(F.count(F.lit(1)).alias("rows"), F.min(date_of("ts")).alias("date"), F.sum("energy").alias("energy"),
                                 last.alias("last"), *moments(("voltage", "active_power")))
    w = Window.partitionBy(*meter)
    in_order = w.orderBy(*cell[len(meter):])
    day = Window.partitionBy(*meter, "date")
    cells = about_mean(cells, ("voltage", "active_power"), w)
    is_day = F.col("date").isNotNull() & (F.row_number().over(day.orderBy(*cell[len(meter):])) == 1)
    cells = cells.withColumn("day", F.when(is_day, F.coalesce(F.sum("energy").over(day), F.lit(0.0))))
    weekend = is_weekend(F.col("date"))
    std = lambda c: std_samp(F.sum(f"{c}__dev").over(w), F.sum(f"{c}__n").over(w))
    cells = cells.select(
        *cell, "day", F.lag("last").over(in_order).alias("before"), F.sum("rows").over(w).alias("n"),
        F.col("voltage__mean").alias("v_mean"), std("voltage").alias("v_std"),
        F.col("active_power__mean").alias("p_mean"), std("active_power").alias("p_std"),
        F.min("active_power__min").over(w).alias("p_min"), F.max("active_power__max").over(w).alias("p_max"),
        F.avg("day").over(w).alias("d_mean"), F.stddev_pop("day").over(w).alias("d_std"),
        F.avg(F.when(~weekend, F.col("day"))).over(w).alias("wd"), F.avg(F.when(weekend, F.col("day"))).over(w).alias("we"))
    z = F.when(F.col("d_std") > 0, (F.col("day") - F.col("d_mean")) / F.col("d_std")).otherwise(F.lit(0.0))
    stats = ("n", "v_mean", "v_std", "p_mean", "p_std", "p_min", "p_max", "d_mean", "d_std", "wd", "we", "abnormal_days")
    days = F.count(F.when(F.col("day").isNotNull() & (F.abs(z) > z_threshold), F.lit(1))).over(w)
    carry = cells.select("*", days.alias("abnormal_days")).drop("day")
    wl = Window.partitionBy(*cell).orderBy(*ORDER)
    x = d.drop("energy").select("*", F.row_number().over(wl).alias("_rn"), F.lag("active_power").over(wl).alias("_prev")).join(carry, cell)
    step = F.col("active_power") - F.when(F.col("_rn") == 1, F.col("before")).otherwise(F.col("_prev"))
    g = x.select("*", step.alias("step"), *_flags(std_threshold)).groupBy(K).agg(
        *[F.first(c).alias(c) for c in stats],
        r(F.first("v_mean")).alias("voltage_mean"), r(F.first("v_std")).alias("voltage_std"),
        r(F.min("voltage")).alias("voltage_min"), r(F.max("voltage")).alias("voltage_max"),
        *_flag_counts(), *_step_counts(F.col("step"), F.col("p_std")))
    # a meter without a day has no consumption part
    has_day = F.col("d_mean").isNotNull()
    late = [F.when(has_day, c).alias(name) for c, name in zip(_consumption_columns(), (
        "daily_mean", "daily_std", "weekday_avg", "weekend_avg", "ratio", "pattern_anomaly", "abnormal_days", "consumption_status"), strict=True)]
    return g.select(K, *_voltage_columns(), *_power_columns(), *late)


def _candidates():
    """All eight possible anomalies of a summary row, in catalogue order, with
    a ``present`` flag; the unified anomaly schema."""
    none = F.lit(None)

    def cand(t, present, count, percent, severity, magnitude):
        _t, source, desc, _sev, causes, rec = dims.ANOMALY_TYPES[dims.ANOMALY_ORD[t] - 1]
        return F.struct(F.lit(dims.ANOMALY_ORD[t]).cast("long").alias("ord"), F.lit(source).alias("source"),
                        F.lit(t).alias("type"), F.coalesce(present, F.lit(False)).alias("present"),
                        count.cast("double").alias("count"), percent.cast("double").alias("percentage"),
                        severity.cast("string").alias("severity"), magnitude.cast("double").alias("magnitude"),
                        F.lit(desc).alias("description"),
                        F.lit(" | ".join(causes) or None).cast("string").alias("possible_causes"), F.lit(rec).cast("string").alias("recommendation"))
    c = F.col
    return F.array(
        cand("voltage_out_of_range", c("out_of_range_count") > 0, c("out_of_range_count"),
             c("out_of_range_percent"), c("out_of_range_severity"), none),
        cand("voltage_sag", c("sag_count") > 0, c("sag_count"), c("sag_percent"), F.lit("medium"), none),
        cand("voltage_swell", c("swell_count") > 0, c("swell_count"), c("swell_percent"), F.lit("medium"), none),
        cand("sudden_power_change", c("sudden_count") > 0, c("sudden_count"), c("sudden_percent"),
             F.lit("medium"), none),
        cand("power_spike", c("spike_count") > 0, c("spike_count"), c("spike_percent"), F.lit("high"),
             c("max_spike")),
        cand("power_drop", c("drop_count") > 0, c("drop_count"), c("drop_percent"), F.lit("medium"), c("max_drop")),
        cand("daily_consumption_anomaly", c("abnormal_days") > 0, c("abnormal_days"), none, none, none),
        cand("usage_pattern_anomaly", c("pattern_anomaly"), none, none, none, c("ratio")),
    )


def anomaly_union(m: DataFrame, std_threshold: float = 3.0, chunk: str | None = "auto",
                  summary: DataFrame | None = None) -> DataFrame:
    """Every detected anomaly of every meter in one schema, in the fixed
    order voltage, power, consumption (``ord``)."""
    j = summary if summary is not None else anomaly_summary(m, std_threshold, chunk)
    present = F.filter(_candidates(), lambda a: a["present"])
    return j.select(K, F.inline(present)).drop("present")


def anomaly_samples(m: DataFrame, std_threshold: float = 3.0) -> DataFrame:
    """The evidence behind the rows of ``anomaly_union`` (same ``ord`` and ``type``): the
    first readings of each voltage anomaly and every abnormal day, in time order."""
    v = voltage_samples(m, std_threshold)
    ords = F.create_map(*[F.lit(x) for t, i in dims.ANOMALY_ORD.items() for x in (t, i)])
    v = v.select(K, ords[F.col("type")].cast("long").alias("ord"), "type", "sample_rank",
                 F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"), F.col("voltage").alias("value"))
    kind = "daily_consumption_anomaly"
    rank = F.row_number().over(Window.partitionBy(K).orderBy("date")).cast("long")  # a meter's abnormal days
    d = daily_zscore(m).select(K, F.lit(dims.ANOMALY_ORD[kind]).cast("long").alias("ord"), F.lit(kind).alias("type"),
                               rank.alias("sample_rank"), F.col("date").cast("string").alias("at"),
                               F.col("energy").alias("value"), "z_score", "deviation")
    return d.unionByName(v, allowMissingColumns=True)


def alert_level(m: DataFrame, std_threshold: float = 3.0, chunk: str | None = "auto",
                max_actions: int = 5, summary: DataFrame | None = None, details: int = 0) -> DataFrame:
    """H17 + H18: per meter (clean meters included) the overall alert level with its text and message,
    counts by severity and source, the three statuses and the recommendations
    of the first five anomalies (``details`` > 0 adds the first ``details``
    anomalies as an array). One projection over the summary row: no
    re-aggregation and no join back."""
    j = summary if summary is not None else anomaly_summary(m, std_threshold, chunk)
    present = F.filter(_candidates(), lambda a: a["present"])
    n = lambda f: F.size(F.filter(present, f)).cast("long")
    total = F.size(present).cast("long")
    high = n(lambda a: a["severity"] == "high")
    medium = n(lambda a: a["severity"] == "medium")
    level = (F.when(high > 0, F.lit("high")).when(medium > 3, F.lit("medium"))
             .when(total > 0, F.lit("low")).otherwise(F.lit("none")))
    recs = F.transform(F.filter(F.slice(present, 1, max_actions), lambda a: a["recommendation"].isNotNull()),
                       lambda a: a["recommendation"])
    text = F.create_map(*[F.lit(x) for code, desc, _msg in dims.ALERT_LEVELS for x in (code, desc)])
    message = F.create_map(*[F.lit(x) for code, _desc, msg in dims.ALERT_LEVELS for x in (code, msg)])
    return j.select(K, level.alias("alert_level"), text[level].alias("alert_level_description"),
                    message[level].alias("summary_message"), total.alias("total_anomalies"), high.alias("high_priority"),
                    medium.alias("medium_priority"),
                    n(lambda a: a["source"] == "voltage").alias("voltage_anomalies"),
                    n(lambda a: a["source"] == "power").alias("power_anomalies"),
                    n(lambda a: a["source"] == "consumption").alias("consumption_anomalies"),
                    "voltage_status", "power_status", "consumption_status",
                    F.array_join(recs, " | ").alias("recommended_actions"),
                    *([F.slice(F.transform(present, lambda a: a.dropFields("present")), 1, details).alias("details")]
                      if details else []))


def alerts(m: DataFrame, view: str = "all", **kw) -> DataFrame:
    """``all`` anomalies, only ``high`` severity, or the per-meter ``summary``;
    an unknown view behaves like ``all``."""
    if view == "summary":
        return alert_level(m, **kw)
    u = anomaly_union(m, **kw)
    return u.where(F.col("severity") == "high") if view == "high" else u


__all__ = ["voltage_flags", "voltage_outliers", "voltage_samples", "power_stats", "high_power_threshold",
           "power_step_anomalies", "rolling_power", "daily_zscore", "consumption_summary", "anomaly_summary",
           "anomaly_union", "anomaly_samples", "alert_level", "alerts"]
