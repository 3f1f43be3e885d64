"""Row-level derived columns (C1-C13) and energy registers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.functions import calendar as cal
from meterlake.functions import derive as dv
from meterlake.functions.numeric import clip, r
from meterlake.plans.ordered import sequential

K = "meter_id"


def derived_columns(m: DataFrame, minutes: float = 1.0) -> DataFrame:
    """Every per-reading derivation of the reference in one projection."""
    return m.select(
        K, "seq", "ts",
        r(dv.current_from_power(), 4).alias("current_from_power"),
        r(dv.reactive_from_pf(), 4).alias("reactive_from_pf"),
        r(dv.reactive_simplified(), 4).alias("reactive_simplified"),
        r(dv.pf_from_pq(), 4).alias("pf_from_pq"),
        r(dv.interval_energy("active_power", minutes), 6).alias("interval_energy"),
        clip("voltage", 198.0, 242.0).alias("voltage_clipped"),
        dv.power_class().alias("power_class"),
        dv.power_class(F.col("active_power"), 2000.0, 500.0).alias("power_class_mixed"),
        cal.date_of().alias("date"), cal.hour_of().cast("long").alias("hour"),
        cal.weekday_of().cast("long").alias("weekday"), cal.is_weekend().alias("is_weekend"),
        cal.period_of(cal.hour_of()).alias("period"),
        cal.season_factor().alias("season_factor"), cal.season_name().alias("season"),
        cal.hour_label(cal.hour_of()).alias("hour_label"),
        dv.is_valid_power().alias("is_valid_power"))


def energy_register(m: DataFrame, chunk: str | None = "auto") -> DataFrame:
    """C5 then C6: the running register per meter and the per-interval values
    recovered from it (a round trip; equal up to float rounding)."""
    x = sequential(m.select(K, "seq", "ts", "energy"), cumsum={"register": "energy"}, chunk=chunk)
    y = sequential(x, lag=["register"], chunk=chunk)
    step = F.col("register") - F.col("prev_register")
    back = F.when(F.col("prev_register").isNull(), F.col("register")).when(step < 0, F.col("register")).otherwise(step)
    return y.select(K, "seq", "ts", "energy", "register", back.alias("energy_from_register"))
