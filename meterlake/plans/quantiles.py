"""Exact quantiles per group with bounded memory (distributed selection).

Spark's exact ``percentile`` aggregate keeps every distinct value of a group
in one buffer, so one meter holding a third of the data would hold a third of
the distinct readings in one task. ``exact_quantile`` finds the same value by
selection instead:

1. per group: n, min, max and a mergeable quantile sketch (partial aggregates); target
   rank ``t = floor((n - 1) * q)``;
2. counting rounds: the group's current candidate range is cut into buckets; counts (partial
   aggregates) and a running sum over the buckets find the bucket holding rank ``t``; its
   actual min / max become the next range and the counts below it the rank offset. In the
   first round the cuts are pivots of the sketch, closely around ``q``: they follow ranks and
   not values, so a few extreme outliers cannot stretch a bucket, and what is left is a share
   of about ``PIVOT_STEP`` of the rows (plus ties). The next ``rounds - 1`` cut that range into
   ``buckets`` of equal width. Buckets are monotone in the value and their counts exact, so
   a pivot that the sketch misplaces costs candidates, never the result;
3. the remaining candidates are counted per distinct value and ranked.

The smallest value above each selected bucket is carried along, so the value
at rank ``t + 1`` needs no extra pass. The result equals Spark's
``percentile`` bit for bit (same position and interpolation arithmetic).
Every window runs over at most ``buckets`` rows (or the distinct values left
in the last bucket) per group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterlake.plans.ordered import join_stats, null_safe_join

#: Ranks between two pivots, as a share of the rows; pivots on each side of the quantile; accuracy of the sketch.
PIVOT_STEP, PIVOTS, ACCURACY = 1 / 1024, 4, 8192

_CARRY = ("_n", "_pos", "_t", "_base", "_next")


def exact_quantile(df: DataFrame, keys, col: str, q: float, out: str = "quantile",
                   buckets: int = 8192, rounds: int = 2, extra_aggs=(), ts: str | None = None) -> DataFrame:
    """``extra_aggs``: aggregate columns over ``df`` computed in the first pass
    and returned next to the quantile (saves the caller a scan). ``ts``: time column
    over whose chunks the rows of a large group are spread in the joins."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    extra_aggs = list(extra_aggs)
    x = df.where(F.col(col).isNotNull()).select(*keys, *([ts] if ts else []), F.col(col).cast("double").alias("_v"))

    def joined(rows, state):
        return join_stats(rows, state, keys, ts) if ts else null_safe_join(rows, state, keys)

    grid = sorted({min(1.0, max(0.0, q + i * PIVOT_STEP)) for i in range(-PIVOTS, PIVOTS + 1)})
    sketch = F.percentile_approx(F.col(col).cast("double"), grid, ACCURACY).alias("_pivots")
    if extra_aggs:
        # first pass over all rows (NULL values included, as the extra aggregates expect)
        st = df.groupBy(*keys).agg(F.count(F.col(col)).alias("_n"), F.min(col).cast("double").alias("_lo"),
                                   F.max(col).cast("double").alias("_hi"), sketch, *extra_aggs)
    else:
        st = x.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"),
                                  F.percentile_approx("_v", grid, ACCURACY).alias("_pivots"))
    extra = [c for c in st.columns if c not in set(keys) | {"_n", "_lo", "_hi", "_pivots"}]
    carry = _CARRY + tuple(extra)
    pos = (F.col("_n") - 1) * float(q)
    cuts = [F.element_at("_pivots", i + 1).alias(f"_p{i}") for i in range(len(grid))]
    state = st.select(*keys, "_n", "_lo", "_hi", *cuts, *extra, pos.alias("_pos"), F.floor(pos).cast("long").alias("_t"),
                      F.lit(0).cast("long").alias("_base"), F.lit(None).cast("double").alias("_next"))
    for turn in range(rounds):
        j = joined(x, state).where((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))
        width = F.col("_hi") - F.col("_lo")
        b = F.when(width > 0, F.least(F.floor((F.col("_v") - F.col("_lo")) / width * buckets),
                                      F.lit(buckets - 1))).otherwise(F.lit(0))
        if turn == 0:
            b = sum((F.when(F.col("_v") >= F.col(f"_p{i}"), F.lit(1)).otherwise(F.lit(0)) for i in range(len(grid))), F.lit(0))
        c = j.groupBy(*keys, b.alias("_b")).agg(
            F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_bmin"), F.max("_v").alias("_bmax"),
            *[F.first(k).alias(k) for k in carry])
        w = Window.partitionBy(*keys).orderBy("_b")
        c = c.select("*", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("_cum"),
                     F.lead("_bmin").over(w).alias("_nb"))
        below = F.col("_base") + F.col("_cum") - F.col("_c")
        sel = c.where((below <= F.col("_t")) & (F.col("_t") < F.col("_base") + F.col("_cum")))
        state = sel.select(*keys, "_n", *extra, F.col("_bmin").alias("_lo"), F.col("_bmax").alias("_hi"), "_pos",
                           "_t", below.alias("_base"), F.coalesce(F.col("_nb"), F.col("_next")).alias("_next"))
    j = joined(x, state).where((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))
    d = j.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"), *[F.first(k).alias(k) for k in carry])
    w = Window.partitionBy(*keys).orderBy("_v")
    d = d.select("*", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("_cum"),
                 F.lead("_v").over(w).alias("_nv"))
    below = F.col("_base") + F.col("_cum") - F.col("_c")
    hit = d.where((below <= F.col("_t")) & (F.col("_t") < F.col("_base") + F.col("_cum")))
    vt = F.col("_v")
    vt1 = F.when(F.col("_t") + 1 < F.col("_base") + F.col("_cum"), vt).otherwise(F.coalesce(F.col("_nv"), F.col("_next")))
    lower, higher = F.col("_t"), F.ceil(F.col("_pos"))
    value = (F.when(higher == lower, vt).when(vt1 == vt, vt)
             .otherwise((higher.cast("double") - F.col("_pos")) * vt + (F.col("_pos") - lower.cast("double")) * vt1))
    res = hit.select(*keys, value.alias(out), *extra)
    if extra:
        # groups without a single value keep their row (NULL quantile), like ``percentile``
        res = res.unionByName(st.where(F.col("_n") == 0).select(*keys, F.lit(None).cast("double").alias(out), *extra))
    return res
