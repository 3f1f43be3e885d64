"""Mergeable partial statistics per cell of readings (a meter's day, hour or chunk).

``moments`` are the aggregates of one cell; ``about_mean`` turns them, with one window per
meter over its cells, into parts that simply add up: squared deviations about the meter's
mean instead of a sum of squares, so nothing cancels when cells are merged. A report that
needs days, hours and the whole meter therefore reads the readings once, whatever number of
levels it rolls up (``levels``); a meter's cells are bounded by its time span, not its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

DAY, HOUR, METER = 0, 1, 2


def moments(columns) -> list[Column]:
    """Per column of a cell: count, sum, squared deviations about the cell's mean, least and largest value."""
    return [e.alias(f"{c}__{name}") for c in columns for name, e in (
        ("n", F.count(c)), ("sum", F.sum(c)), ("dev", F.var_pop(c) * F.count(c)), ("min", F.min(c)), ("max", F.max(c)))]


def about_mean(cells: DataFrame, columns, meter: WindowSpec) -> DataFrame:
    """``<c>__mean``: the meter's mean; ``<c>__dev``: the cell's squared deviations about it."""
    out = cells.withColumns({f"{c}__mean": F.sum(f"{c}__sum").over(meter) / F.nullif(F.sum(f"{c}__n").over(meter), F.lit(0)) for c in columns})
    off = {c: F.try_divide(F.col(f"{c}__sum"), F.col(f"{c}__n")) - F.col(f"{c}__mean") for c in columns}
    return out.withColumns({f"{c}__dev": F.col(f"{c}__dev") + F.col(f"{c}__n") * off[c] * off[c] for c in columns})


def std_samp(dev: Column, n: Column) -> Column:
    """Sample standard deviation of merged parts; NULL for fewer than two values."""
    return F.sqrt(dev / F.when(n > 1, n - 1))


def levels(cells: DataFrame, date: str = "date", hour: str = "hour") -> DataFrame:
    """Every cell once per level: ``level`` and its ``slot`` (days since 1970, the hour, none).
    Cells without a time count for the meter alone."""
    kinds = F.array(F.struct(F.lit(DAY).alias("level"), F.unix_date(date).alias("slot")),
                    F.struct(F.lit(HOUR).alias("level"), F.col(hour).cast("int").alias("slot")),
                    F.struct(F.lit(METER).alias("level"), F.lit(None).cast("int").alias("slot")))
    wanted = F.filter(kinds, lambda k: (k["level"] == METER) | k["slot"].isNotNull())
    return cells.select("*", F.inline(wanted))
