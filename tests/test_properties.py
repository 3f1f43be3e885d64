"""Property tests: column expressions against the Python semantics they mirror."""
import os
from pathlib import PurePosixPath
from urllib.parse import urlparse

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from meterlake.functions import files as FF
from meterlake.functions.numeric import r

PATH_CHARS = "ab.X/?#;-_ "
paths = st.lists(st.text(alphabet=PATH_CHARS, max_size=14), min_size=40, max_size=40)
prefixes = st.sampled_from(["", "/data/", "http://h.example.com/", "https://h/x/", "rel/dir/"])


def _py_ext(path):
    name = os.path.basename(urlparse(path).path)
    return os.path.splitext(name)[1]


@settings(max_examples=6, deadline=None)
@given(paths, prefixes)
def test_extension_matches_urlparse_splitext(spark, names, prefix):
    values = [prefix + n for n in names]
    df = spark.createDataFrame([(v,) for v in values], "p string")
    got = [row.e for row in df.select(FF.file_extension("p").alias("e")).collect()]
    assert got == [_py_ext(v) for v in values]


@settings(max_examples=6, deadline=None)
@given(st.lists(st.text(alphabet="ab.X-_", min_size=1, max_size=12), min_size=40, max_size=40))
def test_suffix_and_stem_match_pathlib(spark, names):
    values = ["dir/" + n for n in names]
    df = spark.createDataFrame([(v,) for v in values], "p string")
    rows = df.select(FF.name_suffix("p").alias("s"), FF.name_stem("p").alias("t")).collect()
    assert [(x.s, x.t) for x in rows] == [(PurePosixPath(v).suffix, PurePosixPath(v).stem) for v in values]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(min_value=-1e6, max_value=1e6, allow_nan=False), min_size=60, max_size=60),
       st.integers(min_value=0, max_value=4))
def test_rounding_matches_numpy(spark, xs, n):
    df = spark.createDataFrame([(float(x),) for x in xs], "x double")
    got = [row.y for row in df.select(r("x", n).alias("y")).collect()]
    want = [float(np.round(x, n)) for x in xs]
    assert all(g == w or (g == 0.0 and w == 0.0) for g, w in zip(got, want))


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 3000), st.one_of(st.none(), st.floats(0, 5000))),
                min_size=1, max_size=120),
       st.sampled_from(["day", "hour"]))
def test_chunked_sequential_equals_plain_window(spark, rows, unit):
    """(meter, minute offset, power) rows with repeated timestamps, multi-day gaps and NULLs."""
    import datetime as dt

    from pyspark.sql import functions as F

    from conftest import readings
    from meterlake.plans.ordered import sequential
    base = dt.datetime(2024, 3, 1)
    data = [{"meter_id": k, "seq": i, "ts": base + dt.timedelta(minutes=7 * off), "active_power": p}
            for i, (k, off, p) in enumerate(rows)]
    m = readings(spark, data).withColumn("one", F.lit(1))
    kw = dict(lag=["active_power"], cumsum={"n": "one"}, row_number="rn")
    cols = ["meter_id", "seq", "prev_active_power", "n", "rn"]
    plain = sorted(tuple(r) for r in sequential(m, chunk=None, **kw).select(*cols).collect())
    chunked = sorted(tuple(r) for r in sequential(m, chunk=unit, **kw).select(*cols).collect())
    assert chunked == plain


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.one_of(st.none(), st.sampled_from([0.0, 1.5, 2.0, 1e6]),
                                                          st.floats(-1e4, 1e4))), min_size=1, max_size=150),
       st.sampled_from([0.0, 0.2, 0.5, 0.8, 0.95, 1.0]), st.sampled_from([(2, 3), (8192, 2), (5, 1)]))
def test_exact_quantile_equals_percentile(spark, rows, q, shape):
    from pyspark.sql import functions as F

    from meterlake.plans.quantiles import exact_quantile
    df = spark.createDataFrame(rows, "k long, v double")
    buckets, rounds = shape
    want = {r.k: r.p for r in df.groupBy("k").agg(F.percentile("v", q).alias("p")).collect() if r.p is not None}
    got = {r.k: r.quantile for r in exact_quantile(df, "k", "v", q, buckets=buckets, rounds=rounds).collect()}
    assert got == want


def _brute_segments(powers, threshold):
    """Plain-Python segmentation of one series (file order = list order)."""
    diffs = [None] + [abs(b - a) for a, b in zip(powers, powers[1:])]
    starts = [0] + [i for i, d in enumerate(diffs) if d is not None and d > threshold]
    ends = starts[1:] + [len(powers)]
    out = []
    for sid, (a, b) in enumerate(zip(starts, ends)):
        seg, ds = powers[a:b], [d for d in diffs[a:b] if d is not None]
        r2 = lambda x: float(np.round(x, 2))  # noqa: E731  (pandas rounding)
        out.append((sid, a, b - 1, b - a, r2(sum(seg) / len(seg)), r2(max(seg)), r2(min(seg)),
                    r2(max(ds)) if ds else None))
    return out


@settings(max_examples=6, deadline=None)
@given(st.lists(st.sampled_from([0.0, 10.0, 55.5, 100.0, 120.25, 400.0, 1000.0, 1049.99, 1500.0]),
                min_size=1, max_size=80),
       st.sampled_from(["day", None]))
def test_segments_match_brute_force(spark, powers, chunk):
    import datetime as dt

    from conftest import readings
    from meterlake.operators.segments import segments
    base = dt.datetime(2024, 3, 1, 20, 0)
    m = readings(spark, [{"seq": i, "ts": base + dt.timedelta(minutes=11 * i), "active_power": p}
                         for i, p in enumerate(powers)])
    got = sorted(segments(m, 50.0, chunk=chunk).collect(), key=lambda r: r.segment_id)
    want = _brute_segments(powers, 50.0)
    t = lambda i: base + dt.timedelta(minutes=11 * i)
    assert [(r.segment_id, r.start_time, r.end_time, r.duration_minutes, r.avg_power, r.max_power, r.min_power,
             r.power_change) for r in got] == \
        [(sid, t(a), t(b), n, av, mx, mn, pc) for sid, a, b, n, av, mx, mn, pc in want]


def _brute_alert(volts, powers, energies, days):
    """One meter, rows in time order; days[i] = (date, weekday). Returns
    (alert level, total, high, medium, statuses, present anomaly types)."""
    n = len(volts)
    v = np.array(volts)
    vm, vs = v.mean(), (v.std(ddof=1) if n > 1 else float("nan"))
    out = int(((v < 198) | (v > 242)).sum())
    sag = int(((v < vm * 0.9) & (v >= 198)).sum())
    swell = int(((v > vm * 1.1) & (v <= 242)).sum())
    found = []
    if out:
        found.append(("voltage_out_of_range", "high" if out / n > 0.05 else "medium"))
    if sag:
        found.append(("voltage_sag", "medium"))
    if swell:
        found.append(("voltage_swell", "medium"))
    p = np.array(powers)
    ps = p.std(ddof=1) if n > 1 else float("nan")
    d = np.diff(p)
    if (np.abs(d) > ps * 3).sum():
        found.append(("sudden_power_change", "medium"))
    if (d > ps * 5).sum():
        found.append(("power_spike", "high"))
    if (d < -ps * 5).sum():
        found.append(("power_drop", "medium"))
    totals, weekend = {}, {}
    for e, (day, wd) in zip(energies, days):
        totals[day] = totals.get(day, 0.0) + e
        weekend[day] = wd >= 5
    t = np.array([totals[k] for k in sorted(totals)])
    sd = t.std()
    z = (t - t.mean()) / sd if sd > 0 else np.zeros(len(t))
    abnormal = int((np.abs(z) > 2).sum())
    if abnormal:
        found.append(("daily_consumption_anomaly", None))
    wd_vals = [totals[k] for k in totals if not weekend[k]]
    we_vals = [totals[k] for k in totals if weekend[k]]
    wd_avg = np.mean(wd_vals) if wd_vals else float("nan")
    we_avg = np.mean(we_vals) if we_vals else float("nan")
    ratio = we_avg / wd_avg if wd_avg > 0 else 0
    if ratio > 1.3:
        found.append(("usage_pattern_anomaly", None))
    high = sum(1 for _, s in found if s == "high")
    medium = sum(1 for _, s in found if s == "medium")
    level = "high" if high else "medium" if medium > 3 else "low" if found else "none"
    statuses = ("normal" if out / n < 0.01 else "attention",
                "abnormal" if any(t_ == "power_spike" for t_, _ in found) else "normal",
                "abnormal" if abnormal > 1 else "normal")
    return level, len(found), high, medium, statuses, [t_ for t_, _ in found]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([185.0, 199.0, 205.0, 220.0, 238.0, 245.0]),
                          st.sampled_from([20.0, 80.0, 150.0, 900.0, 2500.0, 4000.0])), min_size=3, max_size=90),
       st.integers(min_value=1, max_value=600))
def test_alert_level_matches_brute_force(spark, rows, step_minutes):
    import datetime as dt

    from conftest import readings
    from meterlake.operators.anomalies import alert_level, anomaly_union
    base = dt.datetime(2024, 3, 14, 5, 0)
    ts = [base + dt.timedelta(minutes=step_minutes * i) for i in range(len(rows))]
    data = [{"seq": i, "ts": t, "voltage": v, "active_power": p, "energy": p / 60000.0}
            for i, (t, (v, p)) in enumerate(zip(ts, rows))]
    m = readings(spark, data)
    level, total, high, medium, statuses, types = _brute_alert(
        [v for v, _ in rows], [p for _, p in rows], [p / 60000.0 for _, p in rows],
        [(t.date(), t.weekday()) for t in ts])
    a = alert_level(m).collect()[0]
    assert (a.alert_level, a.total_anomalies, a.high_priority, a.medium_priority) == (level, total, high, medium)
    assert (a.voltage_status, a.power_status, a.consumption_status) == statuses
    assert [r.type for r in sorted(anomaly_union(m).collect(), key=lambda r: r.ord)] == types


def _brute_consumption(ts, energies):
    r2 = lambda x: float(np.round(x, 2))
    days, hours = {}, {}
    for t, e in zip(ts, energies):
        days[t.date()] = days.get(t.date(), 0.0) + e
        hours[t.hour] = hours.get(t.hour, 0.0) + e
    dr = {k: r2(v) for k, v in days.items()}                    # rounded daily totals
    order = sorted(dr)
    mx = max(dr.values())
    mn = min(dr.values())
    summary = (len(dr), r2(np.mean(list(dr.values()))), r2(sum(dr.values())),
               str(next(k for k in order if dr[k] == mx)), str(next(k for k in order if dr[k] == mn)))
    hr = {h: r2(v) for h, v in hours.items()}                   # rounded hour totals
    vals = np.array([hr[h] for h in sorted(hr)])
    pt, vt = np.quantile(vals, 0.8), np.quantile(vals, 0.2)
    peaks = ",".join(str(h) for h in sorted(hr) if hr[h] >= pt)
    valleys = ",".join(str(h) for h in sorted(hr) if hr[h] <= vt)
    wd = [v for k, v in days.items() if k.weekday() < 5]
    we = [v for k, v in days.items() if k.weekday() >= 5]
    pct = None
    if wd and we and np.mean(wd) != 0:
        pct = float(np.round((np.mean(we) - np.mean(wd)) / np.mean(wd) * 100, 1))
    return summary, (peaks, valleys), pct


@settings(max_examples=5, deadline=None)
@given(st.lists(st.sampled_from([0.0, 0.01, 0.05, 0.1, 0.25, 1.0]), min_size=2, max_size=120),
       st.integers(min_value=13, max_value=400))
def test_consumption_matches_brute_force(spark, energies, step_minutes):
    import datetime as dt

    from conftest import readings
    from meterlake.operators import consumption as C
    base = dt.datetime(2024, 3, 13, 7, 0)
    ts = [base + dt.timedelta(minutes=step_minutes * i) for i in range(len(energies))]
    m = readings(spark, [{"seq": i, "ts": t, "energy": e} for i, (t, e) in enumerate(zip(ts, energies))])
    summary, (peaks, valleys), pct = _brute_consumption(ts, energies)
    s = C.daily_summary(m).collect()[0]
    assert (s.total_days, s.avg_daily_energy, s.total_energy, str(s.max_day), str(s.min_day)) == summary
    h = C.peak_valley_hours(m).collect()[0]
    assert (h.peak_hours, h.valley_hours) == (peaks, valleys)
    assert C.weekday_weekend(m).collect()[0].difference_percent == pct


def _brute_overall(powers, energies, calibrated):
    p = np.array(powers)
    n, te, avg, peak = len(p), float(np.sum(energies)), p.mean(), p.max()
    base = p[p < 100].mean() if (p < 100).any() else float("nan")
    e = te * 1000 if calibrated else te
    eu = e / (avg * n / 60) if avg > 0 else 0
    lf = avg / peak if peak > 0 else 0
    blr = base / avg if avg > 0 else 0
    raw = eu * 40 + lf * 35 + (1 - blr) * 25
    if not calibrated:
        raw *= 100
    score = 0.0 if np.isnan(raw) else min(100.0, max(0.0, raw))
    level = "excellent" if score >= 85 else "good" if score >= 70 else "fair" if score >= 55 else "poor"
    return float(np.round(score, 1)), level, float(np.round(lf, 3))


@settings(max_examples=5, deadline=None)
@given(st.lists(st.sampled_from([30.0, 95.0, 150.0, 800.0, 1200.0, 2600.0]), min_size=1, max_size=60),
       st.booleans())
def test_overall_efficiency_matches_brute_force(spark, powers, calibrated):
    from conftest import readings
    from meterlake.operators.efficiency import overall_efficiency
    energies = [p / 60000.0 for p in powers]
    m = readings(spark, [{"seq": i, "active_power": p, "energy": e} for i, (p, e) in enumerate(zip(powers, energies))])
    o = overall_efficiency(m, calibrated=calibrated).collect()[0]
    assert (o.overall_score, o.efficiency_level, o.load_factor) == _brute_overall(powers, energies, calibrated)
