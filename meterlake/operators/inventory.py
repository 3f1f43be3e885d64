"""File and object-key inventories (A8, A9, M1-M4) and the conversation window.

Per-file helpers of the reference become column expressions over an
inventory DataFrame (one row per path / key), so millions of objects are
classified, validated and paged in parallel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterlake import dims
from meterlake.functions import files as FF


def classify_files(inv: DataFrame, col: str = "path") -> DataFrame:
    """M1 + M4: category, extension (original case, with dot) and remote flag."""
    c = F.col(col)
    return inv.select("*", FF.file_category(c).alias("category"), FF.file_extension(c).alias("extension"),
                      FF.is_remote(c).alias("is_remote"))


def validate_keys(keys: DataFrame, col: str = "key") -> DataFrame:
    """M2: ``valid`` flag, first failing rule as ``reason`` and the first bad character."""
    c = F.col(col)
    reason = FF.key_invalid_reason(c)
    bad = F.when(reason == "bad_char", FF.key_bad_char(c))
    return keys.select("*", reason.isNull().alias("valid"), reason.alias("reason"), bad.alias("bad_char"))


def unique_keys(names: DataFrame, col: str = "name") -> DataFrame:
    """M3: ``stem_<8 hex>suffix`` object keys (deterministic, retry-safe)."""
    return names.select("*", FF.unique_key(F.col(col)).alias("object_key"))


def list_page(keys: DataFrame, prefix: str | None = None, max_keys: int = 1000,
              continuation_token: str | None = None, col: str = "key") -> DataFrame:
    """One page of keys in byte order after ``continuation_token``,
    filtered by ``prefix``; ``is_truncated`` / ``next_token`` tell whether a
    further page exists. Reads at most ``max_keys + 1`` rows after a global
    top-k (TakeOrderedAndProject), so a page costs O(max_keys) on the driver."""
    if max_keys <= 0 or max_keys > 1000:
        raise ValueError("max_keys must be between 1 and 1000")
    k = F.col(col)
    x = keys.select(k.alias("key"))
    if prefix is not None:
        x = x.where(F.col("key").startswith(prefix))
    if continuation_token is not None:
        x = x.where(F.col("key") > continuation_token)
    top = x.orderBy("key").limit(max_keys + 1)
    w = Window.orderBy("key")  # over at most max_keys + 1 rows
    y = top.select("key", F.row_number().over(w).alias("page_rank"), F.count(F.lit(1)).over(Window.partitionBy()).alias("_n"))
    page = y.where(F.col("page_rank") <= max_keys)
    trunc = F.col("_n") > max_keys
    last = F.max("key").over(Window.partitionBy())
    return page.select("key", F.col("page_rank").cast("long").alias("page_rank"), trunc.alias("is_truncated"),
                       F.when(trunc, last).alias("next_token"))


def size_cap(inv: DataFrame, size_col: str = "size", cap: int = dims.MAX_FILE_BYTES):
    """(accepted, rejected) by byte size; a NULL size is rejected."""
    ok = F.col(size_col).isNotNull() & (F.col(size_col) <= cap)
    return inv.where(ok), inv.where(~ok | F.col(size_col).isNull())


def with_size_check(inv: DataFrame, size_col: str = "size", cap: int = dims.MAX_FILE_BYTES) -> DataFrame:
    s = F.col(size_col)
    return inv.select("*", F.coalesce(s <= cap, F.lit(False)).alias("accepted"),
                      F.when(s.isNull(), F.lit("unknown_size")).when(s > cap, F.lit("too_large")).alias("reject_reason"))


def last_messages(conv: DataFrame, n: int = 40, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """The last ``n`` messages of every conversation, with their position
    in the kept window (a per-group limit, planned as WindowGroupLimit)."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    x = conv.withColumn("_from_end", F.row_number().over(w)).where(F.col("_from_end") <= n)
    return x.drop("_from_end")
