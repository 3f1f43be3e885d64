"""Numeric column helpers (all JVM-side expressions, no UDFs)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FLOATS = (T.DoubleType, T.FloatType)


def r(c, scale: int = 2) -> Column:
    """Round like numpy / pandas ``.round(n)``: scale, round half to even
    (``rint``), scale back. (``bround`` rounds the decimal text instead and
    differs from numpy on values such as 10.254999999999999.)"""
    f = float(10 ** scale)
    return F.rint(_col(c) * f) / f


def div(a, b) -> Column:
    """Division that yields NULL instead of failing or giving Inf on a zero divisor."""
    return F.try_divide(_col(a), _col(b))


def pct(count, total, scale: int = 2) -> Column:
    """``round(count / total * 100, scale)`` with a NULL-safe divisor."""
    return r(F.try_divide(_col(count).cast("double"), _col(total)) * 100.0, scale)


def nan_to_null(c) -> Column:
    """NaN and +/-Inf become NULL so Spark NULL semantics match pandas' NaN skipping."""
    c = _col(c)
    return F.when(F.isnan(c) | c.isin(float("inf"), float("-inf")), F.lit(None)).otherwise(c)


def clean_nan(df: DataFrame, columns=None) -> DataFrame:
    """Normalise every floating column (default) or the given ones; recurses into
    structs and arrays of doubles."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    cols = []
    for name, dtype in fields.items():
        if columns is not None and name not in columns:
            cols.append(F.col(name))
            continue
        cols.append(_clean(F.col(name), dtype).alias(name))
    return df.select(*cols)


def _clean(c: Column, dtype) -> Column:
    if isinstance(dtype, _FLOATS):
        return nan_to_null(c)
    if isinstance(dtype, T.StructType):
        if not any(_has_float(f.dataType) for f in dtype.fields):
            return c
        return F.when(c.isNull(), F.lit(None)).otherwise(
            F.struct(*[_clean(c.getField(f.name), f.dataType).alias(f.name) for f in dtype.fields]))
    if isinstance(dtype, T.ArrayType) and _has_float(dtype.elementType):
        return F.transform(c, lambda x: _clean(x, dtype.elementType))
    return c


def _has_float(dtype) -> bool:
    if isinstance(dtype, _FLOATS):
        return True
    if isinstance(dtype, T.StructType):
        return any(_has_float(f.dataType) for f in dtype.fields)
    if isinstance(dtype, T.ArrayType):
        return _has_float(dtype.elementType)
    return False


def clip(c, lo=None, hi=None) -> Column:
    """Clip to [lo, hi]; NULL stays NULL (``least``/``greatest`` would skip it)."""
    c = _col(c)
    out = c
    if lo is not None:
        out = F.greatest(out, F.lit(lo))
    if hi is not None:
        out = F.least(out, F.lit(hi))
    return F.when(c.isNull(), F.lit(None)).otherwise(out)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c
