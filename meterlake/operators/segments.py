"""Change points and power segments (D1-D2): gaps and islands.

A reading opens a new segment when |P - previous P| > threshold (strict). The
segment id is the running count of change points; segments then aggregate
with an ordinary (partial + final) group-by, so a long flat segment is
combined map-side and never lands whole in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.functions.numeric import r
from meterlake.plans.ordered import sequential

K = "meter_id"


def power_steps(m: DataFrame, chunk: str | None = "auto", keep_chunk: bool = False) -> DataFrame:
    """``power_step`` = P - previous P (NULL on a meter's first row)."""
    x = sequential(m, lag=["active_power"], chunk=chunk, keep_chunk=keep_chunk)
    return x.withColumn("power_step", F.col("active_power") - F.col("prev_active_power")).drop("prev_active_power")


def change_points(m: DataFrame, threshold: float = 50.0, chunk: str | None = "auto", keep=()) -> DataFrame:
    """Readings with ``segment_id``, ``power_diff`` = |step| and ``is_change``
    (plus the ``keep`` columns of the input)."""
    x = power_steps(m.select(K, "seq", "ts", "active_power", *keep), chunk=chunk, keep_chunk=True)
    x = (x.withColumn("power_diff", F.abs("power_step"))
          .withColumn("is_change", F.when(F.col("power_diff") > threshold, F.lit(1)).otherwise(F.lit(0))))
    return sequential(x, cumsum={"segment_id": "is_change"}, chunk=chunk)


def segments(m: DataFrame, threshold: float = 50.0, chunk: str | None = "auto") -> DataFrame:
    """One row per segment; ``duration_minutes`` is the row count and
    ``power_change`` the largest |step| inside it, including the step that
    opened it (NULL for a lone first row)."""
    x = change_points(m, threshold, chunk)
    return (x.groupBy(K, F.col("segment_id").cast("long").alias("segment_id"))
            .agg(F.min("ts").alias("start_time"), F.max("ts").alias("end_time"),
                 F.count(F.lit(1)).alias("duration_minutes"),
                 r(F.avg("active_power")).alias("avg_power"),
                 r(F.max("active_power")).alias("max_power"),
                 r(F.min("active_power")).alias("min_power"),
                 r(F.max("power_diff")).alias("power_change")))
