"""Order-dependent columns per meter without a per-meter hot partition.

A plain ``Window.partitionBy('meter_id').orderBy('ts', 'seq')`` puts every
reading of one meter into one task; a meter that holds a third of the data
would make that one task a third of the job. ``sequential`` therefore runs a
two-level plan when ``chunk`` is set (default ``'day'``):

1. local windows over ``(meter_id, chunk)`` — chunk = ``date_trunc(chunk, ts)``,
   so a hot meter is spread over as many tasks as it has chunks;
2. a per-chunk summary (row count, last row, partial sums). Catalyst prunes
   the local window out of this branch, so it becomes a partial aggregate
   straight off a second, column-pruned scan: combined map-side, only one row
   per (meter, chunk, task) is shuffled. A window over the summary per meter
   (one row per chunk, tiny) turns it into carried values;
3. the carried values (previous chunk's last row, count / sum offsets) are
   joined back on ``(meter_id, chunk)``; the large side keeps its
   (meter, chunk) partitioning, so the readings are shuffled exactly once.

The results equal the plain window exactly (lag, row_number) or up to float
summation order (running sums); ``chunk=None`` selects the plain window.
``rolling`` gives each chunk a halo, the last ``n-1`` rows before it, so every
frame is complete and every task holds a chunk and a halo whatever the meter's size.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY = "meter_id"
ORDER = ("ts", "seq")
_CH, _SUB, _NO_KEY = "_chunk", "_sub", "_no_key"
#: Sequence numbers in one chunk of rows without a time.
TIMELESS = 1 << 16


CHUNK_CONF = "meterlake.chunk"


def resolve_chunk(df: DataFrame, chunk: str | None) -> str | None:
    """``'auto'``: the session setting ``meterlake.chunk`` (default ``'day'``;
    ``'hour'`` / ``'minute'`` for very dense meters, ``'none'`` for plain
    per-meter windows). Any other value is used as given."""
    if chunk != "auto":
        return chunk
    value = (df.sparkSession.conf.get(CHUNK_CONF, "day") or "day").strip().lower()
    return None if value in ("none", "plain", "") else value


def chunk_of(ts: Column, chunk: str) -> Column:
    if chunk == "day":
        return F.to_date(ts)
    if chunk in ("hour", "minute", "week", "month"):
        return F.date_trunc(chunk, ts).cast("timestamp_ntz")
    raise ValueError(f"unknown chunk unit {chunk!r}")


def order_key(d: DataFrame, order) -> Column | None:
    """One DECIMAL(38,0) that sorts exactly like (ts, seq) inside a chunk:
    microseconds since the chunk start x 1e20 + (seq + 2^63). A decimal is a
    mutable aggregation-buffer type, so ``max_by`` on it stays a hash aggregate
    (a struct key would force a sort of every input split). None when the
    order columns are not (timestamp, integral)."""
    if len(order) != 2:
        return None
    t, s = (d.schema[c].dataType for c in order)
    if not isinstance(t, (T.TimestampNTZType, T.TimestampType)) or \
            not isinstance(s, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        return None
    start = F.col(_CH).cast("timestamp_ntz") if isinstance(t, T.TimestampNTZType) else F.col(_CH).cast("timestamp")
    micros = F.coalesce(F.timestamp_diff("MICROSECOND", start, F.col(order[0])), F.lit(0)).cast("decimal(18,0)")
    seq = F.col(order[1]).cast("decimal(20,0)") + F.lit(Decimal(2 ** 63))
    return (micros * F.lit(Decimal(10 ** 20)) + seq).cast("decimal(38,0)")


def sequential(df: DataFrame, *, lag=(), cumsum=None, row_number: str | None = None,
               row_total: str | None = None, key=KEY, order=ORDER, chunk: str | None = "auto", prefix: str = "prev_",
               keep_chunk: bool = False) -> DataFrame:
    """Add ``prev_<c>`` (previous row's value) for every column in ``lag``,
    ``out`` = running sum of ``cumsum[out]`` (NULL where the input is NULL),
    a 1-based ``row_number`` and the group's row count ``row_total``, per ``key`` in ``order``.
    Rows with a NULL key are a group of their own, as in a plain window.

    ``keep_chunk`` keeps the chunk columns; a following ``sequential`` call
    on the result then reuses the existing (meter, chunk) partitioning."""
    chunk = resolve_chunk(df, chunk)
    lag = list(lag)
    cumsum = dict(cumsum or {})
    keys = [key] if isinstance(key, str) else list(key)
    base_cols = [c for c in df.columns if c not in cell_columns(keys)]
    if chunk is None:
        w = Window.partitionBy(*keys).orderBy(*order)
        wr = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        extra = [F.lag(c).over(w).alias(prefix + c) for c in lag]
        extra += [F.when(F.col(c).isNull(), F.lit(None)).otherwise(F.sum(c).over(wr)).alias(o)
                  for o, c in cumsum.items()]
        if row_number:
            extra.append(F.row_number().over(w).alias(row_number))
        if row_total:
            extra.append(F.count(F.lit(1)).over(Window.partitionBy(*keys)).alias(row_total))
        return df.select(*base_cols, *extra)

    d = df if _CH in df.columns else locate(df, keys, order, chunk)
    meter, cell = meter_columns(keys), cell_columns(keys)
    wl = Window.partitionBy(*cell).orderBy(*order)
    wlr = wl.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = d.select(
        *d.columns,
        F.row_number().over(wl).alias("_rn"),
        *[F.lag(c).over(wl).alias("_l_" + c) for c in lag],
        *[F.sum(c).over(wlr).alias("_cs_" + o) for o, c in cumsum.items()],
    )
    aggs = [F.max("_rn").alias("_rows")]
    key = order_key(d, order)
    numeric_lags = all(isinstance(d.schema[c].dataType, T.NumericType) for c in lag)
    if lag and key is not None and numeric_lags:
        # one hash-aggregatable max_by per column, packed into the struct afterwards
        aggs += [F.max_by(F.col(c), key).alias("_last_" + c) for c in lag]
    elif lag:
        aggs.append(F.max_by(F.struct(*[F.col(c) for c in lag]),
                             F.struct(*[F.col(c) for c in order])).alias("_last"))
    aggs += [F.coalesce(F.sum(c), F.lit(0).cast(d.schema[c].dataType)).alias("_csum_" + o)
             for o, c in cumsum.items()]
    summary = x.groupBy(*cell).agg(*aggs)
    if lag and "_last" not in summary.columns:
        summary = summary.withColumn("_last", F.struct(*[F.col("_last_" + c).alias(c) for c in lag]))
    wc = Window.partitionBy(*meter).orderBy(_CH, _SUB)
    before = wc.rowsBetween(Window.unboundedPreceding, -1)
    carry_cols = [F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_before")]
    if lag:
        carry_cols.append(F.lag("_last").over(wc).alias("_carry"))
    carry_cols += [F.coalesce(F.sum("_csum_" + o).over(before), F.lit(0)).alias("_cbefore_" + o) for o in cumsum]
    if row_total:
        carry_cols.append(F.sum("_rows").over(Window.partitionBy(*meter)).alias(row_total))
    carry = summary.select(*cell, *carry_cols)
    j = x.join(carry, cell, "inner")
    out = [F.col(c) for c in base_cols] + ([F.col(c) for c in cell] if keep_chunk else [])
    out += [F.when(F.col("_rn") == 1, F.col("_carry").getField(c)).otherwise(F.col("_l_" + c)).alias(prefix + c)
            for c in lag]
    out += [F.when(F.col(c).isNull(), F.lit(None)).otherwise(F.col("_cs_" + o) + F.col("_cbefore_" + o)).alias(o)
            for o, c in cumsum.items()]
    if row_number:
        out.append((F.col("_rn") + F.col("_rows_before")).alias(row_number))
    if row_total:
        out.append(F.col(row_total))
    return j.select(*out)


def meter_columns(keys) -> list[str]:
    return [*(f"_key{i}" for i in range(len(keys))), _NO_KEY]


def cell_columns(keys) -> list[str]:
    return [*meter_columns(keys), _CH, _SUB]


def _not_null(df: DataFrame, keys) -> DataFrame:
    """``df`` with never-NULL copies of the keys and a bit per key that is NULL, so that plain equi-joins
    on them match NULL with NULL (a null-safe join would not see the windows' partitioning)."""
    copies, bits = {}, F.lit(0)
    for i, k in enumerate(keys):
        t = df.schema[k].dataType
        c = F.col(k) if isinstance(t, (T.NumericType, T.StringType)) else F.col(k).cast("string")
        copies[f"_key{i}"] = F.coalesce(c, F.lit(0).cast(t) if isinstance(t, T.NumericType) else F.lit(""))
        bits = bits + F.when(F.col(k).isNull(), F.lit(1 << i)).otherwise(F.lit(0))
    return df.withColumns(copies | {_NO_KEY: bits})


def locate(df: DataFrame, keys, order, chunk: str) -> DataFrame:
    """``df`` with the columns of its chunk. Rows without a time sort first, as NULLs do in the
    plain window, in chunks of ``TIMELESS`` consecutive sequence numbers."""
    ts, *more = order
    first = F.lit("0001-01-01").cast("date" if chunk == "day" else "timestamp_ntz")
    sub = F.lit(0).cast("long")
    if more and more[0] in df.columns and isinstance(df.schema[more[0]].dataType, T.IntegralType):
        sub = F.when(F.col(ts).isNull(), F.floor(F.col(more[0]) / TIMELESS)).otherwise(sub)
    return _not_null(df, keys).withColumns({_CH: F.coalesce(chunk_of(F.col(ts), chunk), first), _SUB: F.coalesce(sub, F.lit(-(2 ** 62)))})


def null_safe_join(left: DataFrame, right: DataFrame, keys, how: str = "inner") -> DataFrame:
    """``left`` joined to ``right`` on the keys, which appear once; a NULL key matches a NULL key."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    meter = meter_columns(keys)
    a, b = _not_null(left, keys), _not_null(right, keys)
    b = b.select(*meter, *[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    j = a.join(b, meter, how)
    both = [F.coalesce(F.col(k), F.col(f"_r_{k}")).alias(k) if how in ("full", "right") else F.col(k) for k in keys]
    return j.select(*both, *[c for c in left.columns if c not in keys], *[c for c in right.columns if c not in keys])


def join_stats(df: DataFrame, stats: DataFrame, key=KEY, ts: str = "ts", chunk: str | None = "auto") -> DataFrame:
    """Readings with the statistics of their group (one row per ``key``), columns of
    both, without a task per group: the statistics are first joined to the group's
    distinct chunks (a map-side combined list, one row per chunk), and that list is
    joined to the readings on (key, chunk). A following aggregate per key combines
    map-side before its shuffle, since the rows are spread by chunk. A NULL key is a group."""
    keys = [key] if isinstance(key, str) else list(key)
    chunk = resolve_chunk(df, chunk)
    meter, cell = meter_columns(keys), cell_columns(keys)
    df = df.select(*[c for c in df.columns if c not in cell])
    if chunk is None:
        return null_safe_join(df, stats, keys)
    d = locate(df, keys, (ts, ORDER[1]), chunk)
    found = [c for c in stats.columns if c not in keys]
    cells = d.select(*cell).distinct().join(_not_null(stats, keys).select(*meter, *found), meter)
    return d.join(cells, cell).select(*keys, *[c for c in df.columns if c not in keys], *found)


def rolling(df: DataFrame, aggs: dict, n: int = 60, *, key=KEY, order=ORDER,
            chunk: str | None = "auto", block: int | None = None) -> DataFrame:
    """Row-based trailing window of ``n`` rows (current row included, at least
    one row). ``aggs`` = {out name: (aggregate function name, column)}.

    By default each chunk gets a halo: the last ``n-1`` rows before it, so the readings are
    shuffled once. ``block`` cuts each meter into blocks of so many consecutive rows instead."""
    chunk = resolve_chunk(df, chunk)
    keys = [key] if isinstance(key, str) else list(key)
    fns = {name: getattr(F, fn)(col) for name, (fn, col) in aggs.items()}
    if chunk is None:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(n - 1), Window.currentRow)
        return df.select("*", *[e.over(w).alias(name) for name, e in fns.items()])
    if block is None:
        return _rolling_halo(df, fns, {c for _, c in aggs.values()}, n, keys, order, chunk)
    if block < n - 1:
        raise ValueError("block must hold at least n-1 rows")
    base_cols = df.columns
    g = sequential(df, row_number="_g", key=key, order=order, chunk=chunk)
    g = g.withColumn("_b", F.floor((F.col("_g") - 1) / block)).withColumn("_copy", F.lit(False))
    tail = (g.where((F.col("_g") - 1) % block >= block - (n - 1))
            .withColumn("_b", F.col("_b") + 1).withColumn("_copy", F.lit(True)))
    u = g.unionByName(tail)
    w = Window.partitionBy(*keys, "_b").orderBy("_g").rowsBetween(-(n - 1), Window.currentRow)
    res = u.select(*base_cols, "_copy", *[e.over(w).alias(name) for name, e in fns.items()])
    return res.where(~F.col("_copy")).drop("_copy")


def _rolling_halo(df: DataFrame, fns: dict, columns: set, n: int, keys, order, chunk: str) -> DataFrame:
    """Frames over (meter, chunk) and the chunk's halo, in the order of the plain window.

    A chunk's tail (its last ``n-1`` rows) is limited before its shuffle; a chunk's halo is
    the end of the tails of the ``n-1`` chunks before it, as each holds a row at least: so
    chunks that are shorter than the frame chain."""
    if n < 2:
        return df.select("*", *[e.over(Window.partitionBy(*keys, *order).orderBy(*order).rowsBetween(0, 0)).alias(name) for name, e in fns.items()])
    meter, cell = meter_columns(keys), cell_columns(keys)
    d = locate(df, keys, order, chunk)
    held = [*order, *sorted(columns - set(order))]
    back = Window.partitionBy(*cell).orderBy(*[F.desc_nulls_last(c) for c in order])
    tail = d.select(*cell, *held).withColumn("_back", F.row_number().over(back)).where(F.col("_back") < n)
    tails = tail.groupBy(*cell).agg(F.sort_array(F.collect_list(F.struct((-F.col("_back")).alias("_at"), *held))).alias("_tail"))
    before = Window.partitionBy(*meter).orderBy(_CH, _SUB).rowsBetween(-(n - 1), -1)
    halo = tails.select(*cell, F.flatten(F.collect_list("_tail").over(before)).alias("_all"))
    halo = halo.select(*cell, F.slice("_all", F.greatest(F.size("_all") - (n - 2), F.lit(1)), n - 1).alias("_all")) \
        .select(*cell, F.posexplode("_all").alias("_pos", "_row")).select(*cell, "_pos", *[F.col("_row")[c].alias(c) for c in held])
    u = d.withColumns({"_copy": F.lit(False), "_pos": F.lit(n)}).unionByName(halo.withColumn("_copy", F.lit(True)), allowMissingColumns=True)
    w = Window.partitionBy(*cell).orderBy("_pos", *order).rowsBetween(-(n - 1), Window.currentRow)
    res = u.select(*df.columns, "_copy", *[e.over(w).alias(name) for name, e in fns.items()])
    return res.where(~F.col("_copy")).drop("_copy")


def top_n_per_group(df: DataFrame, keys, order_cols, n: int, rank_col: str = "rank") -> DataFrame:
    """Keep the first ``n`` rows per group in ``order_cols`` order (ties broken by
    the given columns). Spark plans ``row_number() <= n`` as a WindowGroupLimit,
    which also limits rows *before* the shuffle."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    w = Window.partitionBy(*keys).orderBy(*order_cols)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= n)
