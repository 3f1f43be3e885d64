"""Registered queries: segmentation, appliance identification, anomalies."""

from __future__ import annotations

from meterlake import dims
from meterlake.catalog import TS_SQL, on_readings, register, rounded, with_mr
from meterlake.operators import appliances as A
from meterlake.operators import segments as S

APPLIANCES_SQL = dims.sql_values(
    dims.appliance_rows(),
    ["ord", "appliance", "appliance_name", "p_lo", "p_hi", "d_lo", "d_hi", "characteristics", "usage_pattern"])

STEPS_CTE = """
steps AS (
  SELECT *, active_power - lag(active_power) OVER (PARTITION BY meter_id ORDER BY ts, seq) AS power_step
  FROM meter_readings)"""

SEGMENTS_CTE = STEPS_CTE + """,
cp AS (
  SELECT *, abs(power_step) AS power_diff,
         sum(CASE WHEN abs(power_step) > 50 THEN 1 ELSE 0 END) OVER (
           PARTITION BY meter_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS segment_id
  FROM steps),
segments AS (
  SELECT meter_id, CAST(segment_id AS BIGINT) AS segment_id, min(ts) AS start_time, max(ts) AS end_time,
         count(*) AS duration_minutes,
         round_even(avg(active_power), 2) AS avg_power, round_even(max(active_power), 2) AS max_power,
         round_even(min(active_power), 2) AS min_power, round_even(max(power_diff), 2) AS power_change
  FROM cp GROUP BY 1, 2)"""

register("segments", with_mr(f"""
SELECT * REPLACE (strftime(start_time, '{TS_SQL}') AS start_time, strftime(end_time, '{TS_SQL}') AS end_time)
FROM segments""", SEGMENTS_CTE))(on_readings(S.segments))

register("power_steps", with_mr(f"""
SELECT meter_id, seq, strftime(ts, '{TS_SQL}') AS ts, active_power, power_step FROM steps""", STEPS_CTE))(
    on_readings(lambda m: S.power_steps(m.select("meter_id", "seq", "ts", "active_power"))))

register("match_by_power", with_mr(f"""
SELECT power, rank, appliance, appliance_name, confidence, power_match, characteristics, usage_pattern FROM (
  SELECT *, row_number() OVER (PARTITION BY power ORDER BY confidence DESC, ord) AS rank FROM (
    SELECT p.power, a.appliance, a.appliance_name, a.ord,
           round_even((CAST(0.6 AS DOUBLE) + CAST(0.4 AS DOUBLE) * ((p.power - a.p_lo) / (a.p_hi - a.p_lo))) * 100.0, 1) AS confidence,
           CAST(a.p_lo AS VARCHAR) || '-' || CAST(a.p_hi AS VARCHAR) || 'W' AS power_match,
           a.characteristics, a.usage_pattern
    FROM (SELECT DISTINCT active_power AS power FROM meter_readings WHERE active_power IS NOT NULL) p
    JOIN {APPLIANCES_SQL} ON p.power >= a.p_lo AND p.power <= a.p_hi) j) WHERE rank <= 3""".replace(
    "AS t(ord", "AS a(ord")))(on_readings(lambda m: A.match_by_power(A.distinct_powers(m))))

register("match_by_segment", with_mr(f"""
SELECT meter_id, segment_id, rank, appliance, appliance_name, confidence, avg_power, duration, power_range,
       characteristics, usage_pattern FROM (
  SELECT *, row_number() OVER (PARTITION BY meter_id, segment_id ORDER BY confidence DESC, ord) AS rank FROM (
    SELECT s.meter_id, s.segment_id, a.appliance, a.appliance_name, a.ord, s.avg_power,
           s.duration_minutes AS duration, CAST(a.p_lo AS VARCHAR) || '-' || CAST(a.p_hi AS VARCHAR) || 'W' AS power_range,
           a.characteristics, a.usage_pattern,
           CAST(least(50 + CASE WHEN s.duration_minutes >= a.d_lo AND s.duration_minutes <= a.d_hi THEN 30 ELSE 0 END
                         + CASE WHEN s.power_change > 100 THEN 10 ELSE 0 END, 95) AS BIGINT) AS confidence
    FROM segments s JOIN {APPLIANCES_SQL} ON s.avg_power >= a.p_lo AND s.avg_power <= a.p_hi) j)
WHERE rank <= 3""".replace("AS t(ord", "AS a(ord"), SEGMENTS_CTE))(on_readings(A.segment_matches))

_USAGE_COUNTS = ",\n".join(
    f"count(*) FILTER (WHERE active_power >= {lo} AND active_power < {hi}) AS b{i}"
    for i, _c, _l, lo, hi in dims.USAGE_BUCKETS)
register("usage_distribution", with_mr("\nUNION ALL\n".join(
    f"SELECT meter_id, CAST({i} AS BIGINT) AS bucket, '{code}' AS category, '{lo}-{hi}W' AS power_range, "
    f"b{i} AS count, round_even(CAST(b{i} AS DOUBLE) / n * 100.0, 2) AS percentage FROM g"
    for i, code, _l, lo, hi in dims.USAGE_BUCKETS),
    f"g AS (SELECT meter_id, count(*) AS n, {_USAGE_COUNTS} FROM meter_readings GROUP BY 1)"))(
    on_readings(A.usage_distribution))

register("top_hours", with_mr("""
SELECT meter_id, 'peak' AS kind, r_hi AS rank, hour, CAST(hour AS VARCHAR) || ':00' AS hour_label,
       round_even(avg_power, 2) AS avg_power FROM x WHERE r_hi <= 5
UNION ALL
SELECT meter_id, 'low', r_lo, hour, CAST(hour AS VARCHAR) || ':00', round_even(avg_power, 2) FROM x WHERE r_lo <= 5""",
    """h AS (SELECT meter_id, CAST(hour(ts) AS BIGINT) AS hour, avg(active_power) AS avg_power
      FROM meter_readings WHERE ts IS NOT NULL GROUP BY 1, 2),
x AS (SELECT *, row_number() OVER (PARTITION BY meter_id ORDER BY avg_power DESC, hour) AS r_hi,
             row_number() OVER (PARTITION BY meter_id ORDER BY avg_power, hour) AS r_lo
      FROM h WHERE avg_power IS NOT NULL)"""))(on_readings(A.top_hours))

# --------------------------------------------------------------------------
# anomalies
# --------------------------------------------------------------------------
from meterlake.operators import anomalies as H  # noqa: E402


def _voltage_ctes(k: float) -> str:
    return f"""
vs AS (SELECT meter_id, count(*) AS n, avg(voltage) AS v_mean, stddev_samp(voltage) AS v_std
       FROM meter_readings GROUP BY 1),
vx AS (SELECT m.*, vs.n, vs.v_mean, vs.v_std,
              (voltage < 198 OR voltage > 242) AS is_out_of_range, voltage < 198 AS is_low, voltage > 242 AS is_high,
              (voltage < v_mean - {k!r} * v_std OR voltage > v_mean + {k!r} * v_std) AS is_outlier,
              (voltage < v_mean * 0.9 AND voltage >= 198) AS is_sag,
              (voltage > v_mean * 1.1 AND voltage <= 242) AS is_swell
       FROM meter_readings m JOIN vs USING (meter_id)),
vg AS (SELECT meter_id, any_value(n) AS n, any_value(v_mean) AS v_mean, any_value(v_std) AS v_std,
              min(voltage) AS vmin, max(voltage) AS vmax,
              count(*) FILTER (WHERE is_out_of_range) AS out_of_range_count,
              count(*) FILTER (WHERE is_low) AS low_count, count(*) FILTER (WHERE is_high) AS high_count,
              count(*) FILTER (WHERE is_outlier) AS outlier_count,
              count(*) FILTER (WHERE is_sag) AS sag_count, count(*) FILTER (WHERE is_swell) AS swell_count
       FROM vx GROUP BY 1),
vf AS (SELECT meter_id, n AS total_records, round_even(v_mean, 2) AS voltage_mean, round_even(v_std, 2) AS voltage_std,
              round_even(vmin, 2) AS voltage_min, round_even(vmax, 2) AS voltage_max,
              out_of_range_count, round_even(CAST(out_of_range_count AS DOUBLE) / n * 100.0, 2) AS out_of_range_percent,
              CASE WHEN CAST(out_of_range_count AS DOUBLE) / n > 0.05 THEN 'high' ELSE 'medium' END AS out_of_range_severity,
              low_count, high_count, outlier_count,
              sag_count, round_even(CAST(sag_count AS DOUBLE) / n * 100.0, 2) AS sag_percent,
              swell_count, round_even(CAST(swell_count AS DOUBLE) / n * 100.0, 2) AS swell_percent,
              CASE WHEN CAST(out_of_range_count AS DOUBLE) / n < 0.01 THEN 'normal' ELSE 'attention' END AS voltage_status
       FROM vg)"""


POWER_CTES = STEPS_CTE + """,
ps AS (SELECT meter_id, count(*) AS n, avg(active_power) AS p_mean, stddev_samp(active_power) AS p_std,
              min(active_power) AS p_min, max(active_power) AS p_max, quantile_cont(active_power, 0.95) AS p_q95
       FROM meter_readings GROUP BY 1),
pa AS (SELECT s.meter_id,
              count(*) FILTER (WHERE abs(power_step) > p_std * 3) AS sudden_count,
              count(*) FILTER (WHERE power_step > p_std * 5) AS spike_count,
              count(*) FILTER (WHERE power_step < -p_std * 5) AS drop_count,
              max(CASE WHEN power_step > p_std * 5 THEN power_step END) AS max_spike_raw,
              min(CASE WHEN power_step < -p_std * 5 THEN power_step END) AS min_drop_raw
       FROM steps s JOIN ps USING (meter_id) GROUP BY 1),
pw AS (SELECT meter_id, round_even(p_mean, 2) AS power_mean, round_even(p_std, 2) AS power_std,
              round_even(p_min, 2) AS power_min, round_even(p_max, 2) AS power_max,
              round_even(p_q95, 2) AS high_power_threshold,
              sudden_count, round_even(CAST(sudden_count AS DOUBLE) / n * 100.0, 2) AS sudden_percent,
              spike_count, round_even(CAST(spike_count AS DOUBLE) / n * 100.0, 2) AS spike_percent,
              round_even(max_spike_raw, 2) AS max_spike,
              drop_count, round_even(CAST(drop_count AS DOUBLE) / n * 100.0, 2) AS drop_percent,
              round_even(abs(min_drop_raw), 2) AS max_drop,
              CAST(spike_count > 0 AS BIGINT) AS high_severity_count,
              CAST(sudden_count > 0 AS BIGINT) + CAST(drop_count > 0 AS BIGINT) AS medium_severity_count,
              CASE WHEN spike_count > 0 THEN 'abnormal' ELSE 'normal' END AS power_status
       FROM pa JOIN ps USING (meter_id))"""

from meterlake.queries_meter import DAILY_TOTALS_CTE  # noqa: E402

CONSUMPTION_CTES = DAILY_TOTALS_CTE + """,
dz0 AS (SELECT *, avg(total_energy) OVER (PARTITION BY meter_id) AS d_mean,
               stddev_pop(total_energy) OVER (PARTITION BY meter_id) AS d_std FROM daily_totals),
dz AS (SELECT *, CASE WHEN d_std > 0 THEN (total_energy - d_mean) / d_std ELSE 0.0 END AS z FROM dz0),
cg AS (SELECT meter_id, any_value(d_mean) AS d_mean, any_value(d_std) AS d_std,
              avg(CASE WHEN NOT is_weekend THEN total_energy END) AS wd,
              avg(CASE WHEN is_weekend THEN total_energy END) AS we,
              count(*) FILTER (WHERE abs(z) > 2) AS abnormal_days
       FROM dz GROUP BY 1),
cs AS (SELECT meter_id, round_even(d_mean, 2) AS daily_mean, round_even(d_std, 2) AS daily_std,
              round_even(wd, 2) AS weekday_avg, round_even(we, 2) AS weekend_avg,
              round_even(CASE WHEN wd > 0 THEN we / wd ELSE 0.0 END, 2) AS ratio,
              coalesce(CASE WHEN wd > 0 THEN we / wd ELSE 0.0 END > 1.3, false) AS pattern_anomaly,
              abnormal_days,
              CASE WHEN abnormal_days > 1 THEN 'abnormal' ELSE 'normal' END AS consumption_status
       FROM cg)"""

ANOMALY_TYPES_SQL = dims.sql_values([(t[0], t[1], t[2], " | ".join(t[4]) or None, t[5]) for t in dims.ANOMALY_TYPES],
                                    ["type", "source", "description", "possible_causes", "recommendation"])

UNION_CTES = _voltage_ctes(3.0) + ",\n" + POWER_CTES + ",\n" + CONSUMPTION_CTES + """,
j AS (SELECT * FROM vf FULL JOIN pw USING (meter_id) FULL JOIN cs USING (meter_id)),
u0 AS (
  SELECT meter_id, 1 AS ord, 'voltage_out_of_range' AS type, out_of_range_count AS count,
         out_of_range_percent AS percentage, out_of_range_severity AS severity, CAST(NULL AS DOUBLE) AS magnitude
  FROM j WHERE out_of_range_count > 0
  UNION ALL SELECT meter_id, 2, 'voltage_sag', sag_count, sag_percent, 'medium', NULL FROM j WHERE sag_count > 0
  UNION ALL SELECT meter_id, 3, 'voltage_swell', swell_count, swell_percent, 'medium', NULL FROM j WHERE swell_count > 0
  UNION ALL SELECT meter_id, 4, 'sudden_power_change', sudden_count, sudden_percent, 'medium', NULL FROM j WHERE sudden_count > 0
  UNION ALL SELECT meter_id, 5, 'power_spike', spike_count, spike_percent, 'high', max_spike FROM j WHERE spike_count > 0
  UNION ALL SELECT meter_id, 6, 'power_drop', drop_count, drop_percent, 'medium', max_drop FROM j WHERE drop_count > 0
  UNION ALL SELECT meter_id, 7, 'daily_consumption_anomaly', abnormal_days, NULL, NULL, NULL FROM j WHERE abnormal_days > 0
  UNION ALL SELECT meter_id, 8, 'usage_pattern_anomaly', NULL, NULL, NULL, ratio FROM j WHERE pattern_anomaly),
anomaly_union AS (
  SELECT u0.meter_id, CAST(u0.ord AS BIGINT) AS ord, t.source, u0.type, CAST(u0.count AS DOUBLE) AS count,
         CAST(u0.percentage AS DOUBLE) AS percentage, CAST(u0.severity AS VARCHAR) AS severity,
         CAST(u0.magnitude AS DOUBLE) AS magnitude, t.description, t.possible_causes, t.recommendation
  FROM u0 JOIN """ + ANOMALY_TYPES_SQL + " USING (type))"

register("voltage_flags", with_mr("SELECT * FROM vf", _voltage_ctes(3.0)))(on_readings(H.voltage_flags))

register("voltage_outliers", with_mr("""
SELECT meter_id, round_even(any_value(v_mean - 1.5 * v_std), 2) AS lower_bound,
       round_even(any_value(v_mean + 1.5 * v_std), 2) AS upper_bound,
       count(*) FILTER (WHERE voltage < v_mean - 1.5 * v_std OR voltage > v_mean + 1.5 * v_std) AS outlier_count,
       count(*) FILTER (WHERE voltage < v_mean - 1.5 * v_std) AS below_count,
       count(*) FILTER (WHERE voltage > v_mean + 1.5 * v_std) AS above_count
FROM vx GROUP BY 1""", _voltage_ctes(1.5)))(on_readings(H.voltage_outliers, std_threshold=1.5))

register("voltage_samples", with_mr(f"""
SELECT meter_id, type, sample_rank, strftime(ts, '{TS_SQL}') AS ts, voltage FROM (
  SELECT *, row_number() OVER (PARTITION BY meter_id, type ORDER BY ts, seq) AS sample_rank FROM (
    SELECT meter_id, ts, seq, voltage, 'voltage_out_of_range' AS type, 5 AS k FROM vx WHERE is_out_of_range
    UNION ALL SELECT meter_id, ts, seq, voltage, 'voltage_sag', 3 FROM vx WHERE is_sag
    UNION ALL SELECT meter_id, ts, seq, voltage, 'voltage_swell', 3 FROM vx WHERE is_swell) s) t
WHERE sample_rank <= k""", _voltage_ctes(3.0)))(on_readings(H.voltage_samples))

register("high_power_threshold", with_mr("""
SELECT meter_id, round_even(any_value(p_q95), 2) AS high_power_threshold,
       count(*) FILTER (WHERE active_power > p_q95) AS above_threshold_count
FROM meter_readings JOIN ps USING (meter_id) GROUP BY 1""", POWER_CTES))(on_readings(H.high_power_threshold))

register("power_step_anomalies", with_mr("SELECT * FROM pw", POWER_CTES))(on_readings(H.power_step_anomalies))

register("rolling_power", with_mr(f"""
SELECT meter_id, seq, strftime(ts, '{TS_SQL}') AS ts, active_power,
       round_even(avg(active_power) OVER w, 7) AS rolling_mean,
       round_even(stddev_samp(active_power) OVER w, 5) AS rolling_std
FROM meter_readings
WINDOW w AS (PARTITION BY meter_id ORDER BY ts, seq ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)"""))(
    # means of cent readings over up to 60 rows tie at 6 dp and fewer
    on_readings(lambda m: rounded(rounded(H.rolling_power(m), 7, "rolling_mean"), 5, "rolling_std")))

register("daily_zscore", with_mr("""
SELECT meter_id, CAST(date AS VARCHAR) AS date, round_even(total_energy, 2) AS energy,
       round_even(z, 2) AS z_score, CASE WHEN z > 0 THEN 'high' ELSE 'low' END AS deviation
FROM dz WHERE abs(z) > 2""", CONSUMPTION_CTES))(on_readings(H.daily_zscore))

register("anomaly_samples", with_mr(f"""
SELECT meter_id, CASE type WHEN 'voltage_out_of_range' THEN 1 WHEN 'voltage_sag' THEN 2 ELSE 3 END::BIGINT AS ord, type,
       sample_rank, strftime(ts, '{TS_SQL}') AS at, voltage AS value, CAST(NULL AS DOUBLE) AS z_score,
       CAST(NULL AS VARCHAR) AS deviation FROM (
  SELECT *, row_number() OVER (PARTITION BY meter_id, type ORDER BY ts, seq) AS sample_rank FROM (
    SELECT meter_id, ts, seq, voltage, 'voltage_out_of_range' AS type, 5 AS k FROM vx WHERE is_out_of_range
    UNION ALL SELECT meter_id, ts, seq, voltage, 'voltage_sag', 3 FROM vx WHERE is_sag
    UNION ALL SELECT meter_id, ts, seq, voltage, 'voltage_swell', 3 FROM vx WHERE is_swell) s) t
WHERE sample_rank <= k
UNION ALL
SELECT meter_id, 7, 'daily_consumption_anomaly', row_number() OVER (PARTITION BY meter_id ORDER BY date),
       CAST(date AS VARCHAR), round_even(total_energy, 2), round_even(z, 2), CASE WHEN z > 0 THEN 'high' ELSE 'low' END
FROM dz WHERE abs(z) > 2""", _voltage_ctes(3.0) + ",\n" + CONSUMPTION_CTES))(on_readings(H.anomaly_samples))

register("weekend_pattern", with_mr("SELECT * FROM cs", CONSUMPTION_CTES))(on_readings(H.consumption_summary))

register("anomaly_union", with_mr("SELECT * FROM anomaly_union", UNION_CTES))(on_readings(H.anomaly_union))

register("alerts_high", with_mr("SELECT * FROM anomaly_union WHERE severity = 'high'", UNION_CTES))(
    on_readings(H.alerts, view="high"))

_LEVELS_SQL = dims.sql_values(dims.ALERT_LEVELS, ["alert_level", "alert_level_description", "summary_message"])
register("alert_level", with_mr(f"""
SELECT * FROM (SELECT meters.meter_id,
       CASE WHEN coalesce(high_priority, 0) > 0 THEN 'high' WHEN coalesce(medium_priority, 0) > 3 THEN 'medium'
            WHEN coalesce(total_anomalies, 0) > 0 THEN 'low' ELSE 'none' END AS alert_level,
       coalesce(total_anomalies, 0) AS total_anomalies, coalesce(high_priority, 0) AS high_priority,
       coalesce(medium_priority, 0) AS medium_priority, coalesce(voltage_anomalies, 0) AS voltage_anomalies,
       coalesce(power_anomalies, 0) AS power_anomalies, coalesce(consumption_anomalies, 0) AS consumption_anomalies,
       voltage_status, power_status, consumption_status, coalesce(recommended_actions, '') AS recommended_actions
FROM (SELECT meter_id, voltage_status, power_status, consumption_status FROM j) meters
LEFT JOIN (
  SELECT meter_id, count(*) AS total_anomalies,
         count(*) FILTER (WHERE severity = 'high') AS high_priority,
         count(*) FILTER (WHERE severity = 'medium') AS medium_priority,
         count(*) FILTER (WHERE source = 'voltage') AS voltage_anomalies,
         count(*) FILTER (WHERE source = 'power') AS power_anomalies,
         count(*) FILTER (WHERE source = 'consumption') AS consumption_anomalies,
         string_agg(recommendation, ' | ' ORDER BY ord) FILTER (WHERE rk <= 5 AND recommendation IS NOT NULL)
           AS recommended_actions
  FROM (SELECT *, row_number() OVER (PARTITION BY meter_id ORDER BY ord) AS rk FROM anomaly_union) a
  GROUP BY 1) g USING (meter_id)) x JOIN {_LEVELS_SQL} USING (alert_level)""", UNION_CTES))(on_readings(H.alert_level))
