"""Registered meter-analytics queries (consumption, profile, quality)."""

from __future__ import annotations

from meterlake import dims
from meterlake.catalog import on_readings, register, with_mr
from meterlake.operators import consumption as C
from meterlake.operators import profile as P

R = "round_even"

DAILY_STATS_CTE = """
daily_stats AS (
  SELECT meter_id, CAST(ts AS DATE) AS date,
         round_even(coalesce(sum(energy), 0), 2) AS total_energy,
         round_even(avg(active_power), 2) AS avg_power,
         round_even(max(active_power), 2) AS max_power,
         round_even(min(active_power), 2) AS min_power,
         round_even(avg(voltage), 2) AS avg_voltage,
         round_even(avg("current"), 2) AS avg_current
  FROM meter_readings WHERE ts IS NOT NULL GROUP BY 1, 2)"""

HOURLY_CTE = """
hourly AS (
  SELECT meter_id, CAST(hour(ts) AS BIGINT) AS hour,
         round_even(coalesce(sum(energy), 0), 2) AS total_energy,
         round_even(avg(active_power), 2) AS avg_power,
         round_even(max(active_power), 2) AS max_power,
         round_even(stddev_samp(active_power), 2) AS power_std,
         round_even(avg(voltage), 2) AS avg_voltage,
         round_even(avg("current"), 2) AS avg_current
  FROM meter_readings WHERE ts IS NOT NULL GROUP BY 1, 2)"""

DAILY_TOTALS_CTE = """
daily_totals AS (
  SELECT meter_id, CAST(ts AS DATE) AS date, coalesce(sum(energy), 0) AS total_energy,
         isodow(CAST(ts AS DATE)) - 1 AS weekday,
         (isodow(CAST(ts AS DATE)) - 1) IN (5, 6) AS is_weekend
  FROM meter_readings WHERE ts IS NOT NULL GROUP BY 1, 2, 4, 5)"""

register("daily_stats", with_mr("SELECT * REPLACE (CAST(date AS VARCHAR) AS date) FROM daily_stats", DAILY_STATS_CTE))(on_readings(C.daily_stats))

register("daily_summary", with_mr("""
SELECT meter_id, count(*) AS total_days,
       round_even(avg(total_energy), 2) AS avg_daily_energy,
       round_even(max(total_energy), 2) AS max_daily_energy,
       round_even(min(total_energy), 2) AS min_daily_energy,
       round_even(stddev_samp(total_energy), 2) AS energy_variance,
       round_even(sum(total_energy), 2) AS total_energy,
       CAST(first(date ORDER BY total_energy DESC, date ASC) AS VARCHAR) AS max_day,
       CAST(first(date ORDER BY total_energy ASC, date ASC) AS VARCHAR) AS min_day
FROM daily_stats GROUP BY 1""", DAILY_STATS_CTE))(on_readings(C.daily_summary))

register("hourly_profile", with_mr("SELECT * FROM hourly", HOURLY_CTE))(on_readings(C.hourly_profile))

register("peak_valley_hours", with_mr("""
SELECT h.meter_id,
       round_even(q.pt, 2) AS peak_threshold, round_even(q.vt, 2) AS valley_threshold,
       coalesce(string_agg(CASE WHEN h.total_energy >= q.pt THEN CAST(h.hour AS VARCHAR) END, ',' ORDER BY h.hour), '') AS peak_hours,
       coalesce(string_agg(CASE WHEN h.total_energy <= q.vt THEN CAST(h.hour AS VARCHAR) END, ',' ORDER BY h.hour), '') AS valley_hours,
       count(*) FILTER (WHERE h.total_energy >= q.pt) AS n_peak_hours,
       count(*) FILTER (WHERE h.total_energy <= q.vt) AS n_valley_hours
FROM hourly h JOIN q USING (meter_id)
GROUP BY h.meter_id, q.pt, q.vt""", HOURLY_CTE + """,
q AS (SELECT meter_id, quantile_cont(total_energy, 0.8) AS pt, quantile_cont(total_energy, 0.2) AS vt
      FROM hourly GROUP BY 1)"""))(on_readings(C.peak_valley_hours))

register("peak_valley_ratio", with_mr("""
SELECT meter_id, round_even(max(total_energy) / greatest(0.001, min(total_energy)), 2) AS peak_valley_ratio
FROM hourly GROUP BY 1""", HOURLY_CTE))(on_readings(C.peak_valley_ratio))

register("weekday_breakdown", with_mr("""
SELECT meter_id, CAST(weekday AS BIGINT) AS weekday,
       round_even(avg(total_energy), 2) AS mean_energy,
       round_even(stddev_samp(total_energy), 2) AS std_energy,
       round_even(sum(total_energy), 2) AS sum_energy,
       (['Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat', 'Sun'])[weekday + 1] AS day
FROM daily_totals GROUP BY meter_id, weekday""", DAILY_TOTALS_CTE))(on_readings(C.weekday_breakdown))

register("weekday_weekend", with_mr("""
SELECT meter_id, round_even(wd, 2) AS weekday_avg, round_even(we, 2) AS weekend_avg,
       round_even(we - wd, 2) AS difference,
       round_even((we - wd) / nullif(wd, 0) * 100.0, 1) AS difference_percent
FROM (SELECT meter_id, avg(CASE WHEN NOT is_weekend THEN total_energy END) AS wd,
             avg(CASE WHEN is_weekend THEN total_energy END) AS we
      FROM daily_totals GROUP BY 1)""", DAILY_TOTALS_CTE))(on_readings(C.weekday_weekend))

register("data_range", with_mr("""
SELECT meter_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start,
       strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS "end", count(*) AS total_records,
       '""" + dims.INTERVAL_LABEL + """' AS time_interval
FROM meter_readings GROUP BY 1"""))(on_readings(P.data_range))

register("profile_stats", with_mr("""
SELECT meter_id, 'voltage' AS "column", round_even(avg(voltage), 2) AS mean, round_even(stddev_samp(voltage), 2) AS std,
       round_even(min(voltage), 2) AS min, round_even(max(voltage), 2) AS max FROM meter_readings GROUP BY 1
UNION ALL
SELECT meter_id, 'current', round_even(avg("current"), 2), round_even(stddev_samp("current"), 2),
       round_even(min("current"), 2), round_even(max("current"), 2) FROM meter_readings GROUP BY 1
UNION ALL
SELECT meter_id, 'active_power', round_even(avg(active_power), 2), round_even(stddev_samp(active_power), 2),
       round_even(min(active_power), 2), round_even(max(active_power), 2) FROM meter_readings GROUP BY 1"""))(
    on_readings(P.profile_stats))

_NULL_COLS = ["seq", "ts", "voltage", "current", "active_power", "reactive_power", "power_factor", "energy"]
register("null_counts", with_mr("\nUNION ALL\n".join(
    f"SELECT meter_id, '{c}' AS \"column\", count(*) FILTER (WHERE \"{c}\" IS NULL) AS missing "
    f"FROM meter_readings GROUP BY 1" for c in _NULL_COLS)))(on_readings(P.null_counts))

register("power_quality", with_mr("""
SELECT *, CASE WHEN out_of_range_percent < 5 THEN 'good' ELSE 'attention' END AS voltage_stability,
          CASE WHEN low_pf_percent < 10 THEN 'good' ELSE 'improve' END AS pf_assessment
FROM (
  SELECT meter_id,
         round_even(avg(voltage), 2) AS voltage_mean, round_even(stddev_samp(voltage), 2) AS voltage_std,
         round_even(min(voltage), 2) AS voltage_min, round_even(max(voltage), 2) AS voltage_max,
         count(*) FILTER (WHERE voltage < 198 OR voltage > 242) AS out_of_range_count,
         round_even(CAST(count(*) FILTER (WHERE voltage < 198 OR voltage > 242) AS DOUBLE) / count(*) * 100.0, 2) AS out_of_range_percent,
         round_even(avg("current"), 2) AS current_mean, round_even(max("current"), 2) AS current_max,
         round_even(stddev_samp("current"), 2) AS current_std,
         round_even(avg(power_factor), 3) AS pf_mean, round_even(min(power_factor), 3) AS pf_min,
         count(*) FILTER (WHERE power_factor < 0.9) AS low_pf_count,
         round_even(CAST(count(*) FILTER (WHERE power_factor < 0.9) AS DOUBLE) / count(*) * 100.0, 2) AS low_pf_percent,
         round_even(avg(active_power), 2) AS power_mean, round_even(stddev_samp(active_power), 2) AS power_std,
         round_even(min(active_power), 2) AS power_min, round_even(max(active_power), 2) AS power_max
  FROM meter_readings GROUP BY 1)"""))(on_readings(P.power_quality))

# --------------------------------------------------------------------------
# efficiency
# --------------------------------------------------------------------------
from meterlake.operators import efficiency as E  # noqa: E402


def _level_case(appliance: str, col: str) -> str:
    whens = " ".join(f"WHEN {col} >= {lo} AND {col} <= {hi} THEN '{lvl}'" for lvl, lo, hi in E._bands(appliance))
    return f"CASE {whens} ELSE 'unknown' END"


def _appliance_eff_sql(unlisted=()) -> str:
    aggs, parts = [], []
    scores = " ".join(f"WHEN '{k}' THEN {v}" for k, v in dims.LEVEL_SCORES.items())
    suggs = " ".join(f"WHEN '{k}' THEN '{' | '.join(v)}'" for k, v in dims.LEVEL_SUGGESTIONS.items())
    for i, a in enumerate(dims.EFFICIENCY_APPLIANCES):
        lo, hi = E.prefilter_range(a)
        cond = f"active_power >= {lo!r} AND active_power <= {hi!r}"
        aggs.append(f"count(*) FILTER (WHERE {cond}) AS n{i}, avg(CASE WHEN {cond} THEN active_power END) AS p{i}, "
                    f"coalesce(sum(CASE WHEN {cond} THEN energy END), 0) AS e{i}")
        lvl = _level_case(a, f"p{i}")
        parts.append(
            f"SELECT meter_id, '{a}' AS appliance, '{E.NAMES[a]}' AS appliance_name, "
            f"CASE WHEN n{i} > 0 THEN 'running' ELSE 'not_running' END AS status, "
            f"CASE WHEN n{i} > 0 THEN {lvl} END AS efficiency_level, "
            f"CASE WHEN n{i} > 0 THEN CAST(coalesce(CASE {lvl} {scores} END, 0) AS DOUBLE) END AS efficiency_score, "
            f"CASE WHEN n{i} > 0 THEN round_even(p{i}, 2) END AS avg_power, "
            f"CASE WHEN n{i} > 0 THEN round_even(e{i}, 2) END AS total_energy, "
            f"CASE WHEN n{i} > 0 THEN round_even(e{i} / 30.0, 2) END AS estimated_daily_usage, "
            f"CASE WHEN n{i} > 0 THEN round_even(CAST(n{i} AS DOUBLE) / 60.0, 1) END AS operating_hours, "
            f"CASE WHEN n{i} > 0 THEN coalesce(CASE {lvl} {suggs} END, '') END AS suggestions, CAST(NULL AS VARCHAR) AS error FROM g")
    for a in unlisted:
        parts.append(f"SELECT meter_id, '{a}', '{E.NAMES[a]}', 'no_standard', NULL, NULL, NULL, NULL, NULL, NULL, NULL, "
                     f"'{dims.NO_STANDARD_TEXT % E.NAMES[a]}' FROM g")
    return with_mr("\nUNION ALL\n".join(parts),
                   f"g AS (SELECT meter_id, {', '.join(aggs)} FROM meter_readings GROUP BY 1)")


register("appliance_efficiency", _appliance_eff_sql())(on_readings(E.appliance_efficiency))

_CATALOGUE = [a for a, *_ in dims.APPLIANCES]
register("appliance_efficiency_all", _appliance_eff_sql([a for a in _CATALOGUE if a not in dims.EFFICIENCY_APPLIANCES]))(
    on_readings(E.appliance_efficiency, appliances=_CATALOGUE))


_OVERALL = {code: text for code, _cut, text in dims.OVERALL_LEVELS}
_RULES = {code: " | ".join(texts) for code, texts in dims.IMPROVEMENT_RULES}


def _overall_sql(calibrated: bool) -> str:
    energy = "te * 1000.0" if calibrated else "te"
    scale = "" if calibrated else " * 100"
    return with_mr("""
SELECT meter_id, round_even(score, 1) AS overall_score, round_even(raw, 1) AS raw_score,
       CASE WHEN score >= 85 THEN 'excellent' WHEN score >= 70 THEN 'good' WHEN score >= 55 THEN 'fair' ELSE 'poor' END
         AS efficiency_level,
       """ + f"CASE WHEN score >= 85 THEN '{_OVERALL['excellent']}' WHEN score >= 70 THEN '{_OVERALL['good']}' "
             f"WHEN score >= 55 THEN '{_OVERALL['fair']}' ELSE '{_OVERALL['poor']}' END" + """ AS level_description,
       coalesce(nullif(concat_ws(' | ', CASE WHEN lf < 0.5 THEN '""" + _RULES["low_load_factor"] + """' END,
                                        CASE WHEN blr > 0.3 THEN '""" + _RULES["high_base_load"] + """' END,
                                        CASE WHEN peak > avg * 3 THEN '""" + _RULES["high_peak"] + """' END), ''),
                '""" + _RULES["ok"] + """') AS improvement_suggestions,
       round_even(eu, 3) AS energy_utilization, round_even(lf, 3) AS load_factor, round_even(blr, 3) AS base_load_ratio,
       round_even(avg, 2) AS average_power, round_even(peak, 2) AS peak_power,
       coalesce(round_even(base, 2), 0.0) AS base_load, round_even(te, 2) AS total_energy,
       coalesce(nullif(concat_ws(',', CASE WHEN lf < 0.5 THEN 'low_load_factor' END,
                                      CASE WHEN blr > 0.3 THEN 'high_base_load' END,
                                      CASE WHEN peak > avg * 3 THEN 'high_peak' END), ''), 'ok') AS suggestions,
       CASE WHEN score >= 85 THEN 'green' WHEN score >= 70 THEN 'amber' ELSE 'red' END AS gauge_color
FROM (SELECT *, least(100.0, greatest(0.0, raw)) AS score
      FROM (SELECT *, (eu * 40 + lf * 35 + (1 - blr) * 25)""" + scale + """ AS raw
            FROM (SELECT *, CASE WHEN avg > 0 THEN """ + energy + """ / (avg * n / 60.0) ELSE 0.0 END AS eu,
                            CASE WHEN peak > 0 THEN avg / peak ELSE 0.0 END AS lf,
                            CASE WHEN avg > 0 THEN base / avg ELSE 0.0 END AS blr
                  FROM (SELECT meter_id, count(*) AS n, coalesce(sum(energy), 0) AS te, avg(active_power) AS avg,
                               max(active_power) AS peak,
                               avg(CASE WHEN active_power < 100 THEN active_power END) AS base
                        FROM meter_readings GROUP BY 1) g) x) y) z""")


register("overall_efficiency", _overall_sql(False))(on_readings(E.overall_efficiency))
register("overall_efficiency_calibrated", _overall_sql(True))(on_readings(E.overall_efficiency, calibrated=True))

_PERIOD_CASE = ("CASE WHEN hour(ts) >= 18 THEN 'evening' WHEN hour(ts) >= 12 THEN 'afternoon' "
                "WHEN hour(ts) >= 6 THEN 'morning' ELSE 'night' END")
PERIOD_EFF_CTE = f"""
pg AS (SELECT meter_id, {_PERIOD_CASE} AS period,
              round_even(avg(active_power), 2) AS avg_power, round_even(stddev_samp(active_power), 2) AS power_std,
              round_even(max(active_power), 2) AS peak_power, round_even(coalesce(sum(energy), 0), 2) AS total_energy,
              round_even(avg(power_factor), 2) AS avg_power_factor
       FROM meter_readings WHERE ts IS NOT NULL GROUP BY 1, 2),
pe AS (SELECT meter_id, period,
              CASE period {' '.join(f"WHEN '{c}' THEN '{zh}'" for c, _s, zh, _ch in dims.PERIODS)} END AS period_label,
              avg_power, power_std, peak_power, total_energy, avg_power_factor,
              greatest(0.0, round_even(100.0 - CASE WHEN avg_power_factor < 0.9 THEN (0.9 - avg_power_factor) * 50 ELSE 0.0 END
                                             - CASE WHEN power_std > avg_power * 0.5 THEN 10.0 ELSE 0.0 END, 1))
                AS efficiency_score
       FROM pg)"""

register("period_efficiency", with_mr("SELECT * FROM pe", PERIOD_EFF_CTE))(on_readings(E.period_efficiency))

_TIE_SQL = dims.sql_values(sorted(dims.PERIOD_TIE_ORDER.items()), ["period", "tie"])
_PERIOD_TEXT = "CASE {} " + " ".join(f"WHEN '{c}' THEN '{zh}'" for c, _s, zh, _ch in dims.PERIODS) + " END"
register("best_worst_period", with_mr(f"""
SELECT *, replace('{dims.BEST_PERIOD_TEXT}', '%s', {_PERIOD_TEXT.format("best_period")}) AS best_recommendation,
       replace('{dims.WORST_PERIOD_TEXT}', '%s', {_PERIOD_TEXT.format("worst_period")}) AS worst_recommendation FROM (
SELECT meter_id,
       first(period ORDER BY avg_power ASC, tie ASC) AS best_period,
       first(avg_power ORDER BY avg_power ASC, tie ASC) AS best_avg_power,
       first(efficiency_score ORDER BY avg_power ASC, tie ASC) AS best_score,
       first(period ORDER BY avg_power DESC, tie ASC) AS worst_period,
       first(avg_power ORDER BY avg_power DESC, tie ASC) AS worst_avg_power,
       first(efficiency_score ORDER BY avg_power DESC, tie ASC) AS worst_score
FROM pe JOIN {_TIE_SQL} USING (period) GROUP BY 1) b""", PERIOD_EFF_CTE))(on_readings(E.best_worst_period))
