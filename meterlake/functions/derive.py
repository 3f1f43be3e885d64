"""Electrical derived columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def current_from_power(power="active_power", voltage="voltage") -> Column:
    """I = P / V, 0 when V <= 0."""
    p, v = _c(power), _c(voltage)
    return F.when(v > 0, p / v).otherwise(F.lit(0.0))


def reactive_from_pf(power="active_power", pf="power_factor") -> Column:
    """Q = P * tan(acos(pf))."""
    return _c(power) * F.tan(F.acos(_c(pf)))


def reactive_simplified(power="active_power", factor: float = 0.3) -> Column:
    return _c(power) * F.lit(factor)


def pf_from_pq(power="active_power", reactive="reactive_power", default: float = 0.95) -> Column:
    """pf = P / sqrt(P^2 + Q^2), ``default`` when undefined."""
    p, q = _c(power), _c(reactive)
    return F.coalesce(F.try_divide(p, F.sqrt(p * p + q * q)), F.lit(default))


def interval_energy(power="active_power", minutes: float = 1.0) -> Column:
    """kWh of one interval: P * minutes / 60 / 1000."""
    return _c(power) * F.lit(float(minutes)) / 60.0 / 1000.0


def power_class(power="active_power", high: float = 1000.0, medium: float = 300.0) -> Column:
    """'high' above ``high``, 'medium' above ``medium``, else 'low' (2000/500 for mixed loads)."""
    p = _c(power)
    return F.when(p > high, F.lit("high")).when(p > medium, F.lit("medium")).otherwise(F.lit("low"))


def is_valid_power(power="active_power", lo: float = 0.0, hi: float = 50000.0) -> Column:
    """Request range check for identification inputs."""
    p = _c(power)
    return p.isNotNull() & (p >= lo) & (p <= hi)


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c
