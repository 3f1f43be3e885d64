"""Reference display labels for the stable codes the operators emit.

Operators return English codes (``good``, ``attention``, ``night`` ...);
``with_reference_labels`` adds ``<column>_label`` with the wording of the
analysed application for every known code column present in a frame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake import dims

_COLUMN_KIND = {
    "voltage_stability": "voltage_quality",
    "pf_assessment": "pf_quality",
    "voltage_status": "voltage_status",
    "power_status": "power_status",
    "consumption_status": "consumption_status",
    "deviation": "deviation",
}


def _lookup(pairs):
    return F.create_map(*[F.lit(v) for kv in pairs for v in kv])


def label_maps() -> dict:
    maps = {col: _lookup(dims.STATUS_LABELS[kind].items()) for col, kind in _COLUMN_KIND.items()}
    maps["period"] = _lookup((c, zh) for c, _s, zh, _ch in dims.PERIODS)
    maps["alert_level"] = _lookup((c, d) for c, d, _m in dims.ALERT_LEVELS)
    maps["appliance"] = _lookup((c, n) for c, n, *_ in dims.APPLIANCES)
    maps["day"] = _lookup((en, zh) for _i, en, zh in dims.WEEKDAYS)
    maps["category"] = _lookup((c, label) for _i, c, label, _lo, _hi in dims.USAGE_BUCKETS)
    return maps


def overall_level_label(col: str = "efficiency_level"):
    return _lookup((c, zh) for c, _cut, zh in dims.OVERALL_LEVELS)[F.col(col)]


def with_reference_labels(df: DataFrame) -> DataFrame:
    maps = label_maps()
    extra = [maps[c][F.col(c)].alias(f"{c}_label") for c in df.columns if c in maps]
    return df.select("*", *extra)
