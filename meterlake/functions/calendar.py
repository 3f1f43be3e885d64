"""Calendar columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from meterlake import dims


def date_of(ts="ts") -> Column:
    return F.to_date(_c(ts))


def hour_of(ts="ts") -> Column:
    return F.hour(_c(ts))


def weekday_of(ts="ts") -> Column:
    """Monday = 0 ... Sunday = 6 (not ``dayofweek``, which starts at Sunday = 1)."""
    return F.weekday(_c(ts))


def is_weekend(ts="ts") -> Column:
    return F.weekday(_c(ts)).isin(5, 6)


def period_of(hour) -> Column:
    """Day period code for an hour column: [0,6) night, [6,12) morning, [12,18) afternoon, else evening."""
    h = _c(hour)
    out = None
    for code, start, *_ in dims.PERIODS:  # later (higher) starts wrap, so they are tested first
        out = F.lit(code) if out is None else F.when(h >= start, F.lit(code)).otherwise(out)
    return F.when(h.isNotNull(), out)


def period_label(code, kind: str = "zh") -> Column:
    """Reference label for a period code (``kind='zh'`` report label, ``'chart'`` chart label)."""
    idx = 2 if kind == "zh" else 3
    m = F.create_map(*[x for p in dims.PERIODS for x in (F.lit(p[0]), F.lit(p[idx]))])
    return m[_c(code)]


def weekday_label(weekday, kind: str = "zh") -> Column:
    idx = 2 if kind == "zh" else 1
    m = F.create_map(*[x for w in dims.WEEKDAYS for x in (F.lit(w[0]), F.lit(w[idx]))])
    return m[_c(weekday)]


def hour_label(hour) -> Column:
    """``h:00`` without zero padding."""
    return F.concat(_c(hour).cast("string"), F.lit(":00"))


def season_factor(ts="ts") -> Column:
    """Load factor by season and hour: Jun-Aug 12-16h 1.3; Dec-Feb 6-9h or 17-21h 1.5; else 1.0."""
    m, h = F.month(_c(ts)), F.hour(_c(ts))
    summer = m.isin(6, 7, 8) & h.between(12, 16)
    winter = m.isin(12, 1, 2) & (h.between(6, 9) | h.between(17, 21))
    return F.when(summer, F.lit(1.3)).when(winter, F.lit(1.5)).otherwise(F.lit(1.0))


def season_index(ts="ts") -> Column:
    """``(month % 12) // 3``: 0 = Dec-Feb, 1 = Mar-May, 2 = Jun-Aug, 3 = Sep-Nov."""
    return F.floor((F.month(_c(ts)) % 12) / 3).cast("int")


# Correct season names for season_index; the legacy list of the simulator is
# shifted by one season (its index 0 is labelled spring).
SEASONS = ["winter", "spring", "summer", "autumn"]
LEGACY_SEASONS = ["spring", "summer", "autumn", "winter"]


def season_name(ts="ts", legacy_labels: bool = False) -> Column:
    names = LEGACY_SEASONS if legacy_labels else SEASONS
    return F.element_at(F.array(*[F.lit(n) for n in names]), season_index(ts) + 1)


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c
