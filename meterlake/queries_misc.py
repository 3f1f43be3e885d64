"""Registered queries: derived columns, chart data, training sets, inventories, conversations."""

from __future__ import annotations

from meterlake import dims
from meterlake.catalog import TS_SQL, on_readings, register, rounded, with_mr
from meterlake.operators import chartdata as K
from meterlake.operators import derived as D
from meterlake.operators import features as L
from meterlake.operators import inventory as M
from meterlake.queries_detect import APPLIANCES_SQL, SEGMENTS_CTE
from meterlake.sources.events import (FILE_INVENTORY_SQL, OBJECT_KEYS_SQL, file_inventory, object_keys,
                                      read_table)

PERIOD_CASE = ("CASE WHEN hour(ts) >= 18 THEN 'evening' WHEN hour(ts) >= 12 THEN 'afternoon' "
               "WHEN hour(ts) >= 6 THEN 'morning' ELSE 'night' END")

# ---------------------------------------------------------------- C1-C13, C5/C6
register("derived_columns", with_mr(f"""
SELECT meter_id, seq, strftime(ts, '{TS_SQL}') AS ts,
       round_even(CASE WHEN voltage > 0 THEN active_power / voltage ELSE 0.0 END, 4) AS current_from_power,
       round_even(active_power * tan(acos(power_factor)), 4) AS reactive_from_pf,
       round_even(active_power * 0.3, 4) AS reactive_simplified,
       round_even(coalesce(active_power / nullif(sqrt(active_power * active_power + reactive_power * reactive_power), 0),
                           0.95), 4) AS pf_from_pq,
       round_even(active_power * 1.0 / 60.0 / 1000.0, 6) AS interval_energy,
       CASE WHEN voltage IS NULL THEN NULL ELSE least(greatest(voltage, 198.0), 242.0) END AS voltage_clipped,
       CASE WHEN active_power > 1000 THEN 'high' WHEN active_power > 300 THEN 'medium' ELSE 'low' END AS power_class,
       CASE WHEN active_power > 2000 THEN 'high' WHEN active_power > 500 THEN 'medium' ELSE 'low' END AS power_class_mixed,
       CAST(CAST(ts AS DATE) AS VARCHAR) AS date, CAST(hour(ts) AS BIGINT) AS hour,
       CAST(isodow(ts) - 1 AS BIGINT) AS weekday, (isodow(ts) - 1) IN (5, 6) AS is_weekend,
       {PERIOD_CASE} AS period,
       CAST(CASE WHEN month(ts) IN (6, 7, 8) AND hour(ts) BETWEEN 12 AND 16 THEN 1.3
                 WHEN month(ts) IN (12, 1, 2) AND (hour(ts) BETWEEN 6 AND 9 OR hour(ts) BETWEEN 17 AND 21) THEN 1.5
                 ELSE 1.0 END AS DOUBLE) AS season_factor,
       (['winter', 'spring', 'summer', 'autumn'])[CAST((month(ts) % 12) // 3 + 1 AS INTEGER)] AS season,
       CAST(hour(ts) AS VARCHAR) || ':00' AS hour_label,
       active_power IS NOT NULL AND active_power >= 0 AND active_power <= 50000 AS is_valid_power
FROM meter_readings"""))(on_readings(D.derived_columns))

register("energy_register", with_mr(f"""
SELECT meter_id, seq, strftime(ts, '{TS_SQL}') AS ts, round_even(energy, 7) AS energy,
       round_even(register, 7) AS register,
       round_even(CASE WHEN prev IS NULL THEN register WHEN register - prev < 0 THEN register
                       ELSE register - prev END, 7) AS energy_from_register
FROM (SELECT *, lag(register) OVER (PARTITION BY meter_id ORDER BY ts, seq) AS prev
      FROM (SELECT meter_id, seq, ts, energy,
                   sum(energy) OVER (PARTITION BY meter_id ORDER BY ts, seq
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS register
            FROM meter_readings) x) y"""))(
    # 7 dp: with readings in whole cents x 7/60000 kWh, registers x 1e6 are
    # multiples of 1/6 (exact rounding ties); x 1e7 they are thirds (no ties)
    on_readings(lambda m: rounded(D.energy_register(m), 7, "energy", "register", "energy_from_register")))

# ---------------------------------------------------------------- K1-K8
register("trend_tail", with_mr(f"""
SELECT meter_id, seq, strftime(ts, '{TS_SQL}') AS ts, active_power, voltage, "current", tail_rank,
       round_even(avg(active_power) OVER (PARTITION BY meter_id), 2) AS tail_mean_power
FROM (SELECT *, row_number() OVER (PARTITION BY meter_id ORDER BY ts DESC, seq DESC) AS tail_rank
      FROM meter_readings) t
WHERE tail_rank <= 200"""))(on_readings(K.trend_tail))

register("daily_bars", with_mr("""
SELECT meter_id, CAST(date AS VARCHAR) AS date, round_even(e, 2) AS total_energy,
       round_even(avg(e) OVER (PARTITION BY meter_id), 2) AS average_energy,
       round_even(sum(e) OVER (PARTITION BY meter_id), 2) AS meter_total,
       row_number() OVER (PARTITION BY meter_id ORDER BY e DESC, date) = 1 AS is_max,
       row_number() OVER (PARTITION BY meter_id ORDER BY e, date) = 1 AS is_min
FROM (SELECT meter_id, CAST(ts AS DATE) AS date, coalesce(sum(energy), 0) AS e
      FROM meter_readings WHERE ts IS NOT NULL GROUP BY 1, 2) d"""))(on_readings(K.daily_bars))

register("hourly_curve", with_mr("""
SELECT meter_id, hour, round_even(a, 2) AS avg_power, round_even(s, 2) AS power_std, round_even(mn, 2) AS min_power,
       round_even(mx, 2) AS max_power, round_even(e, 2) AS total_energy,
       round_even(a - s, 2) AS band_low, round_even(a + s, 2) AS band_high,
       row_number() OVER (PARTITION BY meter_id ORDER BY a DESC, hour) = 1 AS is_peak,
       row_number() OVER (PARTITION BY meter_id ORDER BY a, hour) = 1 AS is_valley
FROM (SELECT meter_id, CAST(hour(ts) AS BIGINT) AS hour, avg(active_power) AS a, stddev_samp(active_power) AS s,
             min(active_power) AS mn, max(active_power) AS mx, coalesce(sum(energy), 0) AS e
      FROM meter_readings WHERE ts IS NOT NULL GROUP BY 1, 2) h"""))(on_readings(K.hourly_curve))

_CHART_LABEL = "CASE period " + " ".join(f"WHEN '{c}' THEN '{ch}'" for c, _s, _zh, ch in dims.PERIODS) + " END"
register("period_share", with_mr(f"""
SELECT meter_id, period, {_CHART_LABEL} AS period_label, round_even(e, 4) AS total_energy,
       round_even(e / sum(e) OVER (PARTITION BY meter_id) * 100.0, 1) AS share_percent
FROM (SELECT meter_id, {PERIOD_CASE} AS period, coalesce(sum(energy), 0) AS e
      FROM meter_readings WHERE ts IS NOT NULL GROUP BY 1, 2) p"""))(on_readings(K.period_share))


def _hist_sql(col: str, bins: int) -> str:
    return with_mr(f"""
SELECT g.meter_id, g.bin, round_even(lo + (bin - 1) * ((hi - lo) / {bins}), 4) AS bin_start,
       round_even(lo + bin * ((hi - lo) / {bins}), 4) AS bin_end, coalesce(c.count, 0) AS count
FROM (SELECT meter_id, lo, hi, CAST(unnest(range(1, {bins + 1})) AS BIGINT) AS bin FROM s) g
LEFT JOIN (SELECT m.meter_id,
                  CAST(least(floor((m.{col} - s.lo) * {bins} / (s.hi - s.lo)), {bins - 1}) + 1 AS BIGINT) AS bin,
                  count(*) AS count
           FROM meter_readings m JOIN s USING (meter_id) WHERE m.{col} IS NOT NULL GROUP BY 1, 2) c
USING (meter_id, bin)""", f"""
s AS (SELECT meter_id, CASE WHEN min({col}) = max({col}) THEN min({col}) - 0.5 ELSE min({col}) END AS lo,
             CASE WHEN min({col}) = max({col}) THEN max({col}) + 0.5 ELSE max({col}) END AS hi
      FROM meter_readings GROUP BY 1)""")


register("voltage_histogram", _hist_sql("voltage", 50))(on_readings(K.voltage_histogram))
register("pf_histogram", _hist_sql("power_factor", 30))(on_readings(K.pf_histogram))

register("quality_scatter", with_mr(f"""
SELECT meter_id, seq, strftime(ts, '{TS_SQL}') AS ts, active_power, reactive_power, power_factor
FROM meter_readings"""))(on_readings(K.quality_scatter))

register("every_tenth", with_mr(f"""
SELECT meter_id, seq, strftime(ts, '{TS_SQL}') AS ts, power_factor, CAST(rn - 1 AS BIGINT) AS position
FROM (SELECT *, row_number() OVER (PARTITION BY meter_id ORDER BY ts, seq) AS rn FROM meter_readings) x
WHERE (rn - 1) % 10 = 0"""))(on_readings(K.every_nth, n=10))

# ---------------------------------------------------------------- L1-L6
_TO_ID = "CASE e.event_type " + " ".join(f"WHEN '{k}' THEN '{a}'" for k, a in dims.EVENT_TYPE_APPLIANCE.items()) + " END"
_NAME = dict(dims.TRAIN_LABELS)
_TO_NAME = "CASE e.event_type " + " ".join(f"WHEN '{k}' THEN '{_NAME[a]}'"
                                           for k, a in dims.EVENT_TYPE_APPLIANCE.items()) + " END"
SAMPLES_CTE = f"""
samples AS (SELECT m.*, {_TO_ID} AS appliance_id, {_TO_NAME} AS appliance_name
            FROM meter_readings m JOIN events e ON e.event_id = m.seq)"""


def on_samples(op, **kw):
    return lambda spark, sf_dir: op(L.samples_from_events(read_table(spark, sf_dir, "events")), **kw)


_LABELS_SQL = dims.sql_values([(c, i) for i, (c, _n) in enumerate(dims.TRAIN_LABELS)], ["appliance_id", "label"])
register("label_encoding", with_mr(f"""
SELECT s.meter_id, s.seq, s.appliance_id, CAST(t.label AS BIGINT) AS label
FROM samples s LEFT JOIN {_LABELS_SQL} ON s.appliance_id = t.appliance_id""", SAMPLES_CTE))(
    on_samples(L.label_encoding))

register("class_stats", with_mr("""
SELECT appliance_name, count(*) AS samples,
       round_even(avg(active_power), 2) AS power_mean, round_even(stddev_samp(active_power), 2) AS power_std,
       round_even(min(active_power), 2) AS power_min, round_even(max(active_power), 2) AS power_max,
       round_even(avg(voltage), 2) AS voltage_mean, round_even(avg("current"), 2) AS current_mean,
       round_even(avg(power_factor), 2) AS power_factor_mean
FROM samples GROUP BY 1""", SAMPLES_CTE))(on_samples(L.class_stats))

register("feature_matrix", with_mr("""
SELECT cp.meter_id, cp.seq, cp.active_power AS power, voltage, "current", power_factor, reactive_power,
       CAST(hour(ts) AS BIGINT) AS hour, CAST((isodow(ts) - 1) IN (5, 6) AS BIGINT) AS is_weekend,
       duration_minutes, coalesce(round_even(power_std, 2), 0.0) AS power_std
FROM cp JOIN (SELECT meter_id, segment_id, count(*) AS duration_minutes, stddev_samp(active_power) AS power_std
              FROM cp GROUP BY 1, 2) seg USING (meter_id, segment_id)""", SEGMENTS_CTE))(
    on_samples(L.feature_matrix))

register("sequences", with_mr(f"""
SELECT meter_id, CAST(floor((rn - 1) / 60) AS BIGINT) AS sequence_id, CAST((rn - 1) % 60 AS BIGINT) AS step, seq,
       strftime(ts, '{TS_SQL}') AS ts, active_power AS power, voltage, "current", power_factor, reactive_power
FROM (SELECT *, row_number() OVER (PARTITION BY meter_id ORDER BY ts, seq) AS rn,
             count(*) OVER (PARTITION BY meter_id) AS n FROM meter_readings) x
WHERE rn <= floor(n / 60) * 60"""))(on_readings(L.sequences))

SUPERPOSITION_SQL = f"""
SELECT meter_id, strftime(slot, '{TS_SQL}') AS timestamp, 'mixed' AS appliance_id,
       array_to_string(list_sort(list_distinct(list(appliance_name))), '+') AS appliance_name,
       count(DISTINCT appliance_id) AS n_devices, round_even(sum(p), 6) AS power,
       CASE WHEN sum(p) > 2000 THEN 'high' WHEN sum(p) > 500 THEN 'medium' ELSE 'low' END AS power_range_category
FROM (SELECT meter_id, date_trunc('hour', ts) AS slot, appliance_id, appliance_name, avg(active_power) AS p
      FROM samples WHERE appliance_id <> 'mixed' GROUP BY ALL) devices
GROUP BY meter_id, slot"""
register("load_superposition", with_mr(SUPERPOSITION_SQL, SAMPLES_CTE))(
    # 6 dp: sums of means over few cent readings tie at fewer places
    on_samples(lambda s: rounded(L.load_superposition(s), 6, "power")))

register("training_set", with_mr(f"""
SELECT strftime(ts, '{TS_SQL}') AS timestamp, appliance_id, appliance_name, round_even(active_power, 2) AS power,
       CASE WHEN active_power > 1000 THEN 'high' WHEN active_power > 300 THEN 'medium' ELSE 'low' END
         AS power_range_category
FROM samples
UNION ALL
SELECT timestamp, appliance_id, appliance_name, power, power_range_category FROM ({SUPERPOSITION_SQL}) mix""",
    SAMPLES_CTE))(on_samples(lambda s: rounded(L.training_set(s), 6, "power")))

# ---------------------------------------------------------------- A8, A9, M1-M4, N1
_CATEGORY = "CASE " + " ".join(
    f"WHEN x IN ({', '.join(repr(e) for e in exts)}) THEN '{cat}'" for cat, exts in dims.FILE_TYPES.items()) \
    + " ELSE 'default' END"
_BASE = ("regexp_extract(regexp_extract(regexp_extract(regexp_replace(path, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*', ''),"
         " '^[^?#]*', 0), '([^/]*)$', 1), '^[^;]*', 0)")
register("file_category", f"""WITH {FILE_INVENTORY_SQL.strip()}
SELECT path, source, {_CATEGORY.replace('x IN', "lower(regexp_replace(ext, '^\\.+', '')) IN")} AS category,
       ext AS extension, starts_with(path, 'http://') OR starts_with(path, 'https://') AS is_remote
FROM (SELECT *, regexp_extract({_BASE}, '^\\.*[^.].*(\\.[^.]*)$', 1) AS ext FROM file_inventory) f""")(
    lambda spark, sf_dir: M.classify_files(file_inventory(spark, sf_dir)))

_REASON = ("CASE WHEN key IS NULL OR regexp_matches(key, '^\\s*$') THEN 'empty' "
           "WHEN strlen(key) > 1024 THEN 'too_long' "
           "WHEN starts_with(key, '/') OR ends_with(key, '/') THEN 'slash_edge' "
           "WHEN strpos(key, '//') > 0 THEN 'double_slash' "
           "WHEN NOT regexp_matches(key, '^[A-Za-z0-9._\\-/]+$') THEN 'bad_char' END")
KEYS_CTE = OBJECT_KEYS_SQL.strip() + f""",
checked AS (SELECT *, {_REASON} AS reason FROM object_keys)"""
register("key_validation", f"""WITH {KEYS_CTE}
SELECT key_id, key, size, reason IS NULL AS valid, reason,
       CASE WHEN reason = 'bad_char' THEN regexp_extract(key, '[^A-Za-z0-9._\\-/]', 0) END AS bad_char
FROM checked""")(lambda spark, sf_dir: M.validate_keys(object_keys(spark, sf_dir)))

register("key_page", f"""WITH {KEYS_CTE}
SELECT key, CAST(page_rank AS BIGINT) AS page_rank, n > 100 AS is_truncated,
       CASE WHEN n > 100 THEN max(key) OVER () END AS next_token
FROM (SELECT key, row_number() OVER (ORDER BY key) AS page_rank, count(*) OVER () AS n
      FROM (SELECT key FROM checked WHERE reason IS NULL AND starts_with(key, 'view/') ORDER BY key LIMIT 101) t) p
WHERE page_rank <= 100""")(
    lambda spark, sf_dir: M.list_page(M.validate_keys(object_keys(spark, sf_dir)).where("valid"),
                                      prefix="view/", max_keys=100))

register("size_check", f"""WITH {OBJECT_KEYS_SQL.strip()}
SELECT key_id, key, size, coalesce(size <= {dims.MAX_FILE_BYTES}, false) AS accepted,
       CASE WHEN size IS NULL THEN 'unknown_size' WHEN size > {dims.MAX_FILE_BYTES} THEN 'too_large' END AS reject_reason
FROM object_keys""")(lambda spark, sf_dir: M.with_size_check(object_keys(spark, sf_dir)))

_LAST = ("(CASE WHEN regexp_extract(regexp_replace(path, '(/+\\.?)+$', ''), '([^/]*)$', 1) = '.' THEN '' "
         "ELSE regexp_extract(regexp_replace(path, '(/+\\.?)+$', ''), '([^/]*)$', 1) END)")
_SUFFIX = f"regexp_extract({_LAST}, '^.+(\\.[^.]+)$', 1)"
register("unique_keys", f"""WITH {FILE_INVENTORY_SQL.strip()}
SELECT path AS name, substr({_LAST}, 1, length({_LAST}) - length({_SUFFIX})) || '_' || substr(sha256(path), 1, 8)
       || lower({_SUFFIX}) AS object_key
FROM file_inventory""")(
    lambda spark, sf_dir: M.unique_keys(file_inventory(spark, sf_dir).selectExpr("path AS name")))

register("last_messages", """
SELECT conv_id, turn, role, text FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) c
WHERE rn <= 3""")(lambda spark, sf_dir: M.last_messages(read_table(spark, sf_dir, "conversations"), n=3))

# ---------------------------------------------------------------- J1-J5 (composites)
from meterlake.catalog import ORACLE  # noqa: E402
from meterlake.plans import reports as J  # noqa: E402

register("consumption_report", f"""
SELECT d.meter_id, d.total_days, d.total_energy, d.avg_daily_energy, d.max_day, d.max_daily_energy, d.min_day,
       d.min_daily_energy, h.peak_hours, h.valley_hours, pv.peak_valley_ratio, w.weekday_avg, w.weekend_avg,
       w.difference_percent, q.voltage_stability, q.voltage_mean, q.voltage_std, q.out_of_range_percent,
       q.pf_assessment, q.pf_mean, q.low_pf_percent, q.power_mean, q.power_std
FROM ({ORACLE['daily_summary']}) d
LEFT JOIN ({ORACLE['peak_valley_hours']}) h USING (meter_id)
LEFT JOIN ({ORACLE['peak_valley_ratio']}) pv USING (meter_id)
LEFT JOIN ({ORACLE['weekday_weekend']}) w USING (meter_id)
LEFT JOIN ({ORACLE['power_quality']}) q USING (meter_id)""")(on_readings(J.consumption_report))

# text and JSON renderings
def _report_text_sql() -> str:
    """The text report assembled in SQL: numbers and NULLs rendered as Java's
    ``format_string('%s')`` does for these rounded values."""
    v = lambda c: f"coalesce(CAST({c} AS VARCHAR), 'null')"
    hours = lambda c: f"array_to_string(list_transform(string_split({c}, ','), lambda h: h || ':00'), ', ')"
    parts = ["'Consumption report\n- period: '", v("total_days"), "' days\n- total: '", v("total_energy"),
             "' kWh\n- daily mean: '", v("avg_daily_energy"), "' kWh\n- highest day: '", v("max_day"), "' ('",
             v("max_daily_energy"), "' kWh)\n- lowest day: '", v("min_day"), "' ('", v("min_daily_energy"),
             "' kWh)\n- peak hours: '", hours("peak_hours"), "'\n- valley hours: '", hours("valley_hours"),
             "'\n- peak/valley ratio: '", v("peak_valley_ratio"), "'\n- weekday mean: '", v("weekday_avg"),
             "' kWh, weekend mean: '", v("weekend_avg"), "' kWh, difference: '", v("difference_percent"),
             "'%\n- voltage: '", v("voltage_stability"), "' (mean '", v("voltage_mean"), "'V, std '",
             v("voltage_std"), "'V, out of range '", v("out_of_range_percent"), "'%)\n- power factor: '",
             v("pf_assessment"), "' (mean '", v("pf_mean"), "', low '", v("low_pf_percent"),
             "'%)\n- mean power: '", v("power_mean"), "'W, std '", v("power_std"), "'W'"]
    return f"SELECT meter_id, {' || '.join(parts)} AS report FROM ({ORACLE['consumption_report']}) c"


register("consumption_report_text", _report_text_sql())(on_readings(J.consumption_report_text))
_DETAIL = ", ".join(f"'{f}': {f}" for f in ("ord", "source", "type", "count", "percentage", "severity", "magnitude",
                                             "description", "possible_causes", "recommendation"))
register("analysis_json", f"""
SELECT r.meter_id, CAST(to_json({{
  'data_summary': {{'start': r.start, 'end': r."end", 'total_records': r.total_records}},
  'daily': {{'total_days': d.total_days, 'total_energy': d.total_energy, 'avg_daily_energy': d.avg_daily_energy,
             'max_daily_energy': d.max_daily_energy, 'min_daily_energy': d.min_daily_energy,
             'energy_variance': d.energy_variance, 'max_day': d.max_day, 'min_day': d.min_day}},
  'efficiency': {{'overall_score': e.overall_score, 'efficiency_level': e.efficiency_level,
                  'load_factor': e.load_factor, 'base_load_ratio': e.base_load_ratio}},
  'alerts': {{'alert_level': a.alert_level, 'alert_level_description': a.alert_level_description,
              'summary_message': a.summary_message, 'total_anomalies': a.total_anomalies, 'high_priority': a.high_priority,
              'medium_priority': a.medium_priority, 'voltage_status': a.voltage_status,
              'power_status': a.power_status, 'consumption_status': a.consumption_status,
              'recommended_actions': a.recommended_actions, 'details': coalesce(t.details, [])}}}}) AS VARCHAR) AS analysis
FROM ({ORACLE['data_range']}) r
LEFT JOIN ({ORACLE['daily_summary']}) d USING (meter_id)
LEFT JOIN ({ORACLE['overall_efficiency']}) e USING (meter_id)
LEFT JOIN ({ORACLE['alert_level']}) a USING (meter_id)
LEFT JOIN (SELECT meter_id, list({{{_DETAIL}}} ORDER BY ord)[1:10] AS details
           FROM ({ORACLE['anomaly_union']}) u GROUP BY 1) t USING (meter_id)""")(on_readings(J.analysis_json))
_STAT_LINE = ("\"column\" || ': mean ' || CAST(mean AS VARCHAR) || ', std ' || CAST(std AS VARCHAR) || "
              "', min ' || CAST(min AS VARCHAR) || ', max ' || CAST(max AS VARCHAR)")
register("load_summary", f"""
SELECT r.meter_id,
       CAST(r.total_records AS VARCHAR) || ' readings from ' || r.start || ' to ' || r."end" || '; ' || s.stats AS summary
FROM ({ORACLE['data_range']}) r
LEFT JOIN (SELECT meter_id, string_agg({_STAT_LINE}, '; ' ORDER BY {_STAT_LINE}) AS stats
           FROM ({ORACLE['profile_stats']}) p GROUP BY 1) s USING (meter_id)""")(on_readings(J.load_summary))

register("efficiency_overview", f"""
SELECT o.*, b.best_period, b.best_avg_power, b.best_score, b.worst_period, b.worst_avg_power, b.worst_score,
       b.best_recommendation, b.worst_recommendation
FROM ({ORACLE['overall_efficiency']}) o
LEFT JOIN ({ORACLE['best_worst_period']}) b USING (meter_id)""")(on_readings(J.efficiency_view))

# one query per branch of the dispatcher (F9), and identification requests
for _kind, _name in (("daily", "daily_stats"), ("hourly", "hourly_profile"), ("weekly", "weekday_breakdown"),
                     ("quality", "power_quality"), ("full", "consumption_report")):
    register(f"analyze_{_kind}", ORACLE[_name])(on_readings(J.analyze, kind=_kind))

REQUESTS_CTE = "requests AS (SELECT DISTINCT value * 150 - 100 AS power FROM events)"
register("identify_requests", f"""WITH {REQUESTS_CTE}
SELECT power, rank, appliance, appliance_name, confidence, power_match, characteristics, usage_pattern, 'matched' AS status
FROM (
  SELECT *, row_number() OVER (PARTITION BY power ORDER BY confidence DESC, ord) AS rank FROM (
    SELECT p.power, a.*, CAST(a.p_lo AS VARCHAR) || '-' || CAST(a.p_hi AS VARCHAR) || 'W' AS power_match,
           round_even((CAST(0.6 AS DOUBLE) + CAST(0.4 AS DOUBLE) * ((p.power - a.p_lo) / (a.p_hi - a.p_lo))) * 100.0, 1)
             AS confidence
    FROM requests p JOIN {APPLIANCES_SQL.replace("AS t(", "AS a(")} ON p.power BETWEEN a.p_lo AND a.p_hi
    WHERE p.power BETWEEN 0 AND 50000) j) x
WHERE rank <= 3
UNION ALL
SELECT power, 0, NULL, NULL, NULL, NULL, NULL, NULL, 'rejected' FROM requests WHERE power < 0 OR power > 50000""")(
    # requests on both sides of the accepted range; a rejected one shows as rank 0
    lambda spark, sf_dir: J.identify(read_table(spark, sf_dir, "events").selectExpr("value * 150 - 100 AS power").distinct())
    .na.fill({"rank": 0}))
