"""Column expressions shared by the operators that run without Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements summed one by one before block totals take over.
BLOCK = 256

SPAN = "array<struct<start:long,rank:int,end:long>>"


def running_sums(values: Column) -> Column:
    """[v1, v1+v2, ...] of an array<int>, in blocks, so that long arrays are not copied per element."""
    zero = F.lit(0).cast("long")
    add = lambda acc, x: acc + x.cast("long")
    step = lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x.cast("long")))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")),
                         lambda b: F.slice(values, b * BLOCK + 1, BLOCK))
    starts = F.aggregate(F.transform(blocks, lambda s: F.aggregate(s, zero, add)), F.array(zero), step)
    sums = F.zip_with(blocks, F.slice(starts, 1, F.size(blocks)), lambda s, o: F.slice(
        F.aggregate(s, F.array(o), step), 2, F.size(s)))
    return F.flatten(sums)


def match_spans(text: Column, pattern: str, rank: int, keep=None) -> Column:
    """``SPAN`` of the leftmost non-overlapping matches of ``pattern``, in code points, end exclusive.

    Gaps and matches alternate, so the running sum of their lengths ends at every match.
    ``keep`` is a condition on the matched text. Texts without a match cost one scan."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    ends = running_sums(F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.length(g) + F.length(m)))
    spans = F.zip_with(found, ends, lambda m, e: F.struct(
        (e - F.length(m)).cast("long").alias("start"), F.lit(rank).alias("rank"), e.cast("long").alias("end"),
        (keep(m) if keep else F.lit(True)).alias("ok")))
    spans = F.transform(F.filter(spans, lambda s: s["ok"]), lambda s: F.struct(s["start"], s["rank"], s["end"]))
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(SPAN)).cast(SPAN)
