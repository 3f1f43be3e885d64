"""Composite per-meter reports (J1-J5) and the analysis dispatchers (F9, H19 views).

Reports join several one-row-per-meter results on ``meter_id``: these sides
grow with the number of meters only, so the joins are small shuffles (or
broadcasts chosen by AQE at run time); the readings are never joined whole.
``consumption_report`` needs no join: it rolls one set of cells up to all its levels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterlake import dims
from meterlake.functions.calendar import date_of, hour_of, is_weekend
from meterlake.functions.derive import is_valid_power
from meterlake.functions.numeric import div, pct, r
from meterlake.operators import anomalies as H
from meterlake.operators import appliances as A
from meterlake.operators import consumption as C
from meterlake.operators import efficiency as E
from meterlake.operators import profile as P
from meterlake.plans.cells import DAY, HOUR, METER, about_mean, levels, moments, std_samp
from meterlake.plans.ordered import null_safe_join

K = "meter_id"


def consumption_report(m: DataFrame, peak_q: float = 0.8, valley_q: float = 0.2) -> DataFrame:
    """Daily, hourly, weekly and quality figures of each meter in one row, from one pass
    over the readings: cells per (meter, date, hour), rolled up to days, hours and the meter.
    Day and hour totals are rounded before they are summarised, as in F1-F6."""
    quality = ("voltage", "power_factor", "active_power")
    cells = m.groupBy(K, date_of("ts").alias("date"), hour_of("ts").alias("hour")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("energy").alias("energy"),
        F.count_if((F.col("voltage") < dims.V_MIN) | (F.col("voltage") > dims.V_MAX)).alias("out"),
        F.count_if(F.col("power_factor") < dims.LOW_PF).alias("low"), *moments(quality))
    parts = levels(about_mean(cells, quality, Window.partitionBy(K)))
    x = parts.groupBy(K, "level", "slot").agg(
        F.coalesce(F.sum("energy"), F.lit(0.0)).alias("total"),
        *[F.sum(c).alias(c) for c in ("n", "out", "low")],
        *[F.sum(f"{c}__{s}").alias(f"{c}__{s}") for c in quality for s in ("n", "dev")],
        *[F.first(f"{c}__mean").alias(f"{c}__mean") for c in quality])
    day, hour, meter = (F.col("level") == level for level in (DAY, HOUR, METER))
    date, total = F.date_from_unix_date("slot"), r("total")
    of_days, of_hours = F.when(day, total), F.when(hour, total)
    weekend = is_weekend(date)
    one = lambda c: F.first(F.when(meter, c), ignorenulls=True)
    std = lambda c: one(std_samp(F.col(f"{c}__dev"), F.col(f"{c}__n")))
    g = x.groupBy(K).agg(
        F.count_if(day).alias("total_days"), r(F.sum(of_days)).alias("total_energy"), r(F.avg(of_days)).alias("avg_daily_energy"),
        F.max_by(date, F.when(day, F.struct(total, -F.col("slot")))).alias("max_day"), r(F.max(of_days)).alias("max_daily_energy"),
        F.min_by(date, F.when(day, F.struct(total, F.col("slot")))).alias("min_day"), r(F.min(of_days)).alias("min_daily_energy"),
        F.percentile(of_hours, peak_q).alias("_peak"), F.percentile(of_hours, valley_q).alias("_valley"),
        F.array_sort(F.collect_list(F.when(hour, F.struct(F.col("slot").alias("hour"), total.alias("total_energy"))))).alias("_hours"),
        r(F.max(of_hours) / F.greatest(F.lit(0.001), F.min(of_hours))).alias("peak_valley_ratio"),
        F.avg(F.when(day & ~weekend, F.col("total"))).alias("_wd"), F.avg(F.when(day & weekend, F.col("total"))).alias("_we"),
        pct(one(F.col("out")), one(F.col("n"))).alias("out_of_range_percent"), pct(one(F.col("low")), one(F.col("n"))).alias("low_pf_percent"),
        r(one(F.col("voltage__mean"))).alias("voltage_mean"), r(std("voltage")).alias("voltage_std"),
        r(one(F.col("power_factor__mean")), 3).alias("pf_mean"),
        r(one(F.col("active_power__mean"))).alias("power_mean"), r(std("active_power")).alias("power_std"))
    peaks, valleys = C.peak_and_valley("_hours", "_peak", "_valley")
    stability, assessment = P.verdicts()
    return g.where(F.col("total_days") > 0).select(
        K, "total_days", "total_energy", "avg_daily_energy", "max_day", "max_daily_energy", "min_day", "min_daily_energy",
        C.hour_list(peaks).alias("peak_hours"), C.hour_list(valleys).alias("valley_hours"), "peak_valley_ratio",
        r("_wd").alias("weekday_avg"), r("_we").alias("weekend_avg"),
        r(div(F.col("_we") - F.col("_wd"), F.col("_wd")) * 100.0, 1).alias("difference_percent"),
        stability, "voltage_mean", "voltage_std", "out_of_range_percent", assessment, "pf_mean", "low_pf_percent",
        "power_mean", "power_std")


def consumption_report_text(m: DataFrame) -> DataFrame:
    """J1 as text (one formatted report per meter)."""
    report = consumption_report(m)
    hours = lambda c: F.array_join(F.transform(F.split(F.col(c), ","), lambda h: F.concat(h, F.lit(":00"))), ", ")
    text = F.format_string(
        "Consumption report\n"
        "- period: %s days\n- total: %s kWh\n- daily mean: %s kWh\n"
        "- highest day: %s (%s kWh)\n- lowest day: %s (%s kWh)\n"
        "- peak hours: %s\n- valley hours: %s\n- peak/valley ratio: %s\n"
        "- weekday mean: %s kWh, weekend mean: %s kWh, difference: %s%%\n"
        "- voltage: %s (mean %sV, std %sV, out of range %s%%)\n"
        "- power factor: %s (mean %s, low %s%%)\n- mean power: %sW, std %sW",
        "total_days", "total_energy", "avg_daily_energy", F.col("max_day").cast("string"), "max_daily_energy",
        F.col("min_day").cast("string"), "min_daily_energy", hours("peak_hours"), hours("valley_hours"), "peak_valley_ratio", "weekday_avg",
        "weekend_avg", "difference_percent", "voltage_stability", "voltage_mean", "voltage_std",
        "out_of_range_percent", "pf_assessment", "pf_mean", "low_pf_percent", "power_mean", "power_std")
    return report.select(K, text.alias("report"))


def analysis_json(m: DataFrame, chunk: str | None = "auto") -> DataFrame:
    """The file-analysis result (summary, daily, efficiency, alerts with the
    anomaly details) as one JSON document per meter."""
    rng = P.data_range(m)
    daily = C.daily_summary(m)
    eff = E.overall_efficiency(m).select(K, "overall_score", "efficiency_level", "load_factor", "base_load_ratio")
    alert = H.alert_level(m, chunk=chunk, details=10)  # first ten anomalies from the same summary row
    j = rng
    for part in (daily, eff, alert):
        j = null_safe_join(j, part, K, "left")
    doc = F.struct(
        F.struct("start", "end", "total_records").alias("data_summary"),
        F.struct("total_days", "total_energy", "avg_daily_energy", "max_daily_energy", "min_daily_energy",
                 "energy_variance", "max_day", "min_day").alias("daily"),
        F.struct("overall_score", "efficiency_level", "load_factor", "base_load_ratio").alias("efficiency"),
        F.struct("alert_level", "alert_level_description", "summary_message", "total_anomalies", "high_priority", "medium_priority", "voltage_status",
                 "power_status", "consumption_status", "recommended_actions",
                 F.coalesce(F.col("details"), F.array()).alias("details")).alias("alerts"))
    # NULL fields stay in the document (explicit nulls, as in the reference's JSON)
    return j.select(K, F.to_json(doc, {"ignoreNullFields": "false"}).alias("analysis"))


def load_summary(m: DataFrame) -> DataFrame:
    """Data range and basic statistics of each meter as text."""
    rng = P.data_range(m)
    st = P.profile_stats(m).groupBy(K).agg(F.array_join(F.array_sort(F.collect_list(F.format_string(
        "%s: mean %s, std %s, min %s, max %s", "column", "mean", "std", "min", "max"))), "; ").alias("stats"))
    j = null_safe_join(rng, st, K, "left")
    return j.select(K, F.format_string("%s readings from %s to %s; %s", "total_records", "start", "end",
                                       "stats").alias("summary"))


def efficiency_view(m: DataFrame, appliance: str | None = None) -> DataFrame:
    """One appliance's efficiency, or the overall score with the best and
    worst period when no appliance is given."""
    if appliance:
        return E.appliance_efficiency(m, [appliance])
    return null_safe_join(E.overall_efficiency(m), E.best_worst_period(m), K, "left")


def identify(requests: DataFrame, power: str = "power", top: int = 3) -> DataFrame:
    """Identification for a table of requested power values; requests
    outside 0-50000 W get a ``rejected`` row instead of matches."""
    ok = requests.where(is_valid_power(power))
    bad = requests.where(~is_valid_power(power)).select(power, F.lit("rejected").alias("status"))
    hits = A.match_by_power(ok.select(power).distinct(), power, top).withColumn("status", F.lit("matched"))
    return hits.unionByName(bad, allowMissingColumns=True)


ANALYSES = ("daily", "hourly", "weekly", "quality", "full")


def analyze(m: DataFrame, kind: str = "full") -> DataFrame:
    """dispatcher over the consumption analyses; an unknown kind gives the
    full report."""
    if kind == "daily":
        return C.daily_stats(m)
    if kind == "hourly":
        return C.hourly_profile(m)
    if kind == "weekly":
        return C.weekday_breakdown(m)
    if kind == "quality":
        return P.power_quality(m)
    return consumption_report(m)


CHARTS = ("trend", "daily", "hourly", "period", "voltage", "power_factor", "scatter", "pf_series")


def chart_data(m: DataFrame, kind: str, **kw):
    """The table behind one chart (K1-K8); an unknown kind gives ``None``
    (the reference draws nothing for it)."""
    from meterlake.operators import chartdata as K
    table = {
        "trend": K.trend_tail, "daily": K.daily_bars, "hourly": K.hourly_curve, "period": K.period_share,
        "voltage": K.voltage_histogram, "power_factor": K.pf_histogram, "scatter": K.quality_scatter,
        "pf_series": K.every_nth,
    }.get(kind)
    return table(m, **kw) if table else None
