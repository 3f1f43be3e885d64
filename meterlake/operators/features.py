"""Training-set preparation.

Samples are labelled readings: ``appliance_id`` / ``appliance_name`` per row.
Label encoding uses the fixed dictionary order through a broadcast join (not
StringIndexer, whose order follows label frequency). Per-class statistics are
a plain group-by: five to eleven very large groups, combined map-side.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake import dims
from meterlake.functions.calendar import hour_of, is_weekend
from meterlake.functions.derive import power_class
from meterlake.functions.numeric import r
from meterlake.operators.segments import change_points
from meterlake.plans.ordered import join_stats, sequential
from meterlake.sources.events import meter_readings_from_events

K = "meter_id"
FEATURES = ["power", "voltage", "current", "power_factor", "reactive_power", "hour", "is_weekend",
            "duration_minutes", "power_std"]


def samples_from_events(events: DataFrame) -> DataFrame:
    """Labelled readings: the ``events`` fleet with ``event_type`` mapped to an
    appliance label through a fixed dictionary."""
    m = meter_readings_from_events(events, keep=["event_type"])
    to_id = F.create_map(*[v for k, a in dims.EVENT_TYPE_APPLIANCE.items() for v in (F.lit(k), F.lit(a))])
    names = F.create_map(*[v for a, n in dims.TRAIN_LABELS for v in (F.lit(a), F.lit(n))])
    aid = to_id[F.col("event_type")]
    return m.select(*[c for c in m.columns if c != "event_type"], aid.alias("appliance_id"),
                    names[aid].alias("appliance_name"))


def union_samples(*frames: DataFrame) -> DataFrame:
    """L1: bag union by column name (missing columns become NULL)."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def feature_matrix(samples: DataFrame, threshold: float = 50.0, chunk: str | None = "auto") -> DataFrame:
    """L2: the nine model features per sample. ``duration_minutes`` and
    ``power_std`` describe the power segment the reading belongs to (segment
    aggregates joined back on (meter, segment, chunk), not a window per segment)."""
    cp = change_points(samples, threshold, chunk, keep=("voltage", "current", "power_factor", "reactive_power"))
    seg = cp.groupBy(K, "segment_id").agg(F.count(F.lit(1)).alias("duration_minutes"),
                                          F.stddev_samp("active_power").alias("power_std"))
    x = join_stats(cp, seg, [K, "segment_id"], chunk=chunk)
    return x.select(K, "seq", F.col("active_power").alias("power"), "voltage", "current", "power_factor",
                    "reactive_power", hour_of("ts").cast("long").alias("hour"),
                    is_weekend("ts").cast("long").alias("is_weekend"), "duration_minutes",
                    F.coalesce(r("power_std"), F.lit(0.0)).alias("power_std"))


def label_encoding(samples: DataFrame) -> DataFrame:
    """L3: label = position of ``appliance_id`` in the fixed dictionary (``mixed`` last)."""
    lab = dims.label_df(samples.sparkSession).select("appliance_id", F.col("label").cast("long").alias("label"))
    return samples.select(K, "seq", "appliance_id").join(lab, "appliance_id", "left")


def class_stats(samples: DataFrame) -> DataFrame:
    """L4: per class power mean / std / min / max and mean voltage, current, pf."""
    P = F.col("active_power")
    return samples.groupBy("appliance_name").agg(
        F.count(F.lit(1)).alias("samples"),
        r(F.avg(P)).alias("power_mean"), r(F.stddev_samp(P)).alias("power_std"),
        r(F.min(P)).alias("power_min"), r(F.max(P)).alias("power_max"),
        r(F.avg("voltage")).alias("voltage_mean"), r(F.avg("current")).alias("current_mean"),
        r(F.avg("power_factor")).alias("power_factor_mean"))


def sequences(m: DataFrame, length: int = 60, chunk: str | None = "auto") -> DataFrame:
    """Cut each meter's readings into consecutive sequences of ``length``
    steps; an incomplete tail is dropped."""
    x = sequential(m, row_number="_rn", row_total="_n", chunk=chunk).where(F.col("_rn") <= F.floor(F.col("_n") / length) * length)
    pos = F.col("_rn") - 1
    return x.select(K, F.floor(pos / length).cast("long").alias("sequence_id"),
                    (pos % length).cast("long").alias("step"), "seq", "ts",
                    F.col("active_power").alias("power"), "voltage", "current", "power_factor", "reactive_power")


def load_superposition(samples: DataFrame, slot: str = "hour") -> DataFrame:
    """Loads running in the same household (meter) and time slot: one mean power
    per device, summed into one mixed sample whose name joins the distinct device
    names with '+' (at most the dictionary's size per slot)."""
    single = samples.where(F.col("appliance_id") != "mixed")
    devices = single.groupBy(K, F.date_trunc(slot, "ts").cast("timestamp_ntz").alias("timestamp"),
                             "appliance_id", "appliance_name").agg(F.avg("active_power").alias("_p"))
    g = devices.groupBy(K, "timestamp").agg(
        F.sum("_p").alias("_p"),
        F.array_join(F.array_sort(F.collect_set("appliance_name")), "+").alias("appliance_name"),
        F.count_distinct("appliance_id").alias("n_devices"))
    return g.select(K, "timestamp", F.lit("mixed").alias("appliance_id"), "appliance_name", "n_devices",
                    F.col("_p").alias("power"), power_class(F.col("_p"), 2000.0, 500.0).alias("power_range_category"))


def training_set(samples: DataFrame, slot: str = "hour") -> DataFrame:
    """L1 over L6: all labelled samples, mixed ones too, plus the mixed samples of every slot."""
    single = samples.select(
        F.col("ts").alias("timestamp"), "appliance_id", "appliance_name", r("active_power").alias("power"),
        power_class(F.col("active_power")).alias("power_range_category"))
    mixed = load_superposition(samples, slot).drop(K, "n_devices")
    return union_samples(single, mixed)
