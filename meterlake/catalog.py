"""Registered queries: one Spark callable and (when SQL can express it) one
DuckDB oracle SQL per operator of the inventory.

Every query reads the driver tables of ``sf_dir`` (mostly through the
``meter_readings`` recipe over ``events``) and returns flat scalar columns whose
names match the oracle SQL exactly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.functions.numeric import r
from meterlake.sources.events import MR_SQL, meter_readings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = lambda spark, sf_dir: flat(fn(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def flat(df: DataFrame) -> DataFrame:
    """Registered outputs carry dates as 'yyyy-MM-dd' and times as
    'yyyy-MM-dd HH:mm:ss.SSSSSS' strings, so both engines print them alike."""
    if not any(f.dataType.typeName() == "date" or f.dataType.typeName().startswith("timestamp")
               for f in df.schema.fields):
        return df
    cols = []
    for f in df.schema.fields:
        t = f.dataType.typeName()
        if t == "date":
            cols.append(F.col(f.name).cast("string").alias(f.name))
        elif t.startswith("timestamp"):
            cols.append(F.date_format(f.name, TS_TEXT).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


TS_TEXT = "yyyy-MM-dd HH:mm:ss.SSSSSS"
TS_SQL = "%Y-%m-%d %H:%M:%S.%f"


def on_readings(op, **kw):
    """Query = operator applied to the fleet derived from ``events``."""
    return lambda spark, sf_dir: op(meter_readings(spark, sf_dir), **kw)


def rounded(df: DataFrame, scale: int, *cols: str) -> DataFrame:
    """Round only for the comparison between engines; operators return full values."""
    return df.withColumns({c: r(c, scale) for c in cols})


def with_mr(body: str, ctes: str = "") -> str:
    """Oracle SQL over the ``meter_readings`` recipe (plus extra CTEs)."""
    extra = f",\n{ctes}" if ctes else ""
    return f"WITH {MR_SQL}{extra}\n{body}"


from meterlake import queries_meter  # noqa: E402,F401  (registers entries)
from meterlake import queries_detect  # noqa: E402,F401
from meterlake import queries_misc  # noqa: E402,F401
from meterlake import queries_ingest  # noqa: E402,F401
