"""Best-fit packing of documents into sequences by the linear grouping scheme.

1. Every document becomes its token ids and an end id; one that is longer than a sequence is
   cut into full sequences, its first piece takes what is left over. No shuffle.
2. The lengths (at most ``capacity`` different ones) are counted. On these counts alone the
   packing is planned: pieces above ``capacity / SMALL`` are sorted and cut into groups of
   equal cardinality, lengths are rounded up to the longest of their group, and a
   configuration linear programme over the few rounded sizes (column generation, whose
   pricing is a knapsack) gives the multisets that fill sequences, with how often each is
   used. Rounded down, they are filled with actual pieces, longest first; what the rounding
   leaves over (a few pieces a configuration) is packed best-fit decreasing; small pieces go,
   longest first, into the fullest sequence that still takes them.
3. The plan never names a document: it maps intervals of (length, rank) to intervals of
   sequences, and its size is bounded by the number of lengths, configurations and gaps,
   whatever the number of documents. Pieces get their rank within their length by a
   two-level count (about the square root of the pieces in any group), look their place up
   and are done; a third of all pieces may have one length.

Defined results: NULL and empty texts are the end id alone; repeated rows and NULL ids are
packed like any others; an empty table gives no rows; only id and text are read, so other
columns cannot clash; very long texts give many full sequences.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterlake.llm.byte_bpe import ByteBpe
from meterlake.llm.common import cut

CAPACITY, END_ID = 2048, 0
#: Groups of the scheme, and the share of a sequence up to which a piece counts as small.
GROUPS, SMALL = 192, 8
#: Steps of the linear programme at most (every step leaves a feasible plan), and how near to its optimum it may stop.
STEPS, NEAR = 4000, 1e-3

_RANK_BITS = 48


def cut_pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
               capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: the pieces of every document."""
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end = ByteBpe(tokenizer), np.array([end_id], "<u4")
        for batch in batches:
            rows, out = [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                ids = np.concatenate([bpe.encode(text).astype("<u4"), end]) if text else end
                start = 0
                for k, stop in enumerate(range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)):
                    rows.append(row)
                    out.append((k, start, stop - start, zlib.crc32(ids[start:stop].tobytes())))
                    start = stop
            piece, first, length, crc = zip(*out, strict=True) if out else ((),) * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()),
                 *(pa.array(x, pa.int64()) for x in (first, length, crc))], names=["doc_id", "piece", "start", "length", "ids_crc32"])
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return read.mapInArrow(pieces, "doc_id long, piece int, start long, length long, ids_crc32 long")


def equal_groups(counts: np.ndarray, smallest: int, largest: int, groups: int) -> tuple[np.ndarray, list[list[list[int]]]]:
    """Rounded sizes (descending) and, for each, its pieces as slices [length, first rank, pieces], longest first.

    Groups of one rounded size are one."""
    each = max(1, math.ceil(int(counts[smallest:largest + 1].sum()) / groups))
    sizes: list[int] = []
    slices: list[list[list[int]]] = []
    room = 0
    for length in range(largest, smallest - 1, -1):
        rank, left = 0, int(counts[length])
        while left:
            if not room:
                room = each
                if not sizes or sizes[-1] != length:
                    sizes.append(length)
                    slices.append([])
            n = min(room, left)
            slices[-1].append([length, rank, n])
            rank, left, room = rank + n, left - n, room - n
    return np.array(sizes, np.int64), slices


def _knapsack(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Worth and counts of the best multiset of sizes within the capacity, copy by copy of each size."""
    best, steps = np.zeros(capacity + 1), []
    for j in np.flatnonzero(worth > 0):
        s = int(sizes[j])
        for _ in range(capacity // s):
            value = best[:-s] + worth[j]
            better = value > best[s:] + 1e-12
            if not better.any():
                break
            best[s:] = np.where(better, value, best[s:])
            steps.append((j, s, better))
    counts, c = np.zeros(len(sizes), np.int64), capacity
    for j, s, better in reversed(steps):
        if c >= s and better[c - s]:
            counts[j] += 1
            c -= s
    return float(best[capacity]), counts


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """(counts per size, whole times used): the configuration programme, rounded down.

    Column generation from one-size configurations; the duals price the next column."""
    k = len(sizes)
    columns = np.diag(capacity // sizes).astype(float)
    inverse = np.diag(1.0 / (capacity // sizes))
    x = inverse @ demand
    for step in range(1, STEPS + 1):
        duals = inverse.sum(axis=0)
        worth, column = _knapsack(sizes, duals, capacity)
        if worth <= 1 + NEAR:  # no solution uses fewer than a share 1 / worth of the present one
            break
        way = inverse @ column
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(way > 1e-9, x / way, np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        columns[:, out] = column
        if step % 64 == 0:
            inverse = np.linalg.inv(columns)
        else:
            row = inverse[out] / way[out]
            inverse -= np.outer(way, row)
            inverse[out] = row
        x = np.maximum(inverse @ demand, 0.0)
    times = np.floor(x + 1e-6).astype(np.int64)
    for i in range(k):  # rounding errors may not use a piece twice
        a = columns[:, i] > 0
        while times[i] and (columns[a] @ times > demand[a] + 1e-6).any():
            times[i] -= 1
    return [(columns[:, i].astype(np.int64), int(times[i])) for i in range(k) if times[i] > 0]


class Plan:
    """Rows (length, first rank, first sequence, pieces a sequence, offset) and the sequences used."""

    def __init__(self, capacity: int):
        self.capacity, self.sequences = capacity, 0
        self.rows: list[tuple[int, int, int, int, int]] = []
        #: free tokens -> intervals (first sequence, sequences)
        self.free: defaultdict[int, list[tuple[int, int]]] = defaultdict(list)

    def fill(self, layers: list[list[list[int]]], times: int) -> None:
        """New sequences, each with one piece of every layer; a layer is ``times`` pieces in slices."""
        parts = [(0, times, 0)]
        for layer in layers:
            at, new = 0, []
            todo = iter(parts)
            first, n, used = next(todo)
            for length, rank, pieces in layer:
                while pieces:
                    if at == first + n:
                        first, n, used = next(todo)
                    m = min(pieces, first + n - at)
                    self.rows.append((length, rank, self.sequences + at, 1, used))
                    new.append((at, m, used + length))
                    at, rank, pieces = at + m, rank + m, pieces - m
            parts = new
        for first, n, used in parts:
            self.free[self.capacity - used].append((self.sequences + first, n))
        self.sequences += times

    def best_fit(self, length: int, rank: int, pieces: int) -> None:
        """Pieces of one length, each into the fullest sequence that takes it."""
        for f in [f for f in range(length, self.capacity + 1) if self.free.get(f)]:
            each, kept = f // length, []
            for first, n in self.free[f]:
                if not pieces:
                    kept.append((first, n))
                    continue
                full = min(n, pieces // each)
                m = min(n * each, pieces)
                self.rows.append((length, rank, first, each, self.capacity - f))
                if full:
                    self.free[f - each * length].append((first, full))
                rank, pieces = rank + m, pieces - m
                if m > full * each:
                    self.free[f - (m - full * each) * length].append((first + full, 1))
                    full += 1
                if n > full:
                    kept.append((first + full, n - full))
            self.free[f] = kept
            if not pieces:
                return
        each = self.capacity // length
        full, over = divmod(pieces, each)
        self.rows.append((length, rank, self.sequences, each, 0))
        if full:
            self.free[self.capacity - each * length].append((self.sequences, full))
        if over:
            self.free[self.capacity - over * length].append((self.sequences + full, 1))
        self.sequences += full + (over > 0)


def _take(slices: list[list[int]], n: int) -> list[list[int]]:
    """The first ``n`` pieces of a group, removed from it."""
    out = []
    while n:
        length, rank, have = slices[0]
        m = min(n, have)
        out.append([length, rank, m])
        if m == have:
            slices.pop(0)
        else:
            slices[0] = [length, rank + m, have - m]
        n -= m
    return out


def plan_packing(counts: np.ndarray, capacity: int = CAPACITY, groups: int = GROUPS, small: int = SMALL) -> Plan:
    """The plan for ``counts[length]`` pieces of every length up to the capacity."""
    plan = Plan(capacity)
    if counts[capacity]:
        plan.fill([[[capacity, 0, int(counts[capacity])]]], int(counts[capacity]))
    least = capacity // small + 1
    sizes, slices = equal_groups(counts, least, capacity - 1, groups)
    if len(sizes):
        demand = np.array([sum(s[2] for s in group) for group in slices], float)
        for pattern, times in configurations(sizes, demand, capacity):
            plan.fill([_take(slices[g], times) for g in np.repeat(np.arange(len(sizes)), pattern)], times)
        for group in slices:
            for length, rank, n in group:
                plan.best_fit(length, rank, n)
    for length in range(least - 1, 0, -1):
        if counts[length]:
            plan.best_fit(length, 0, int(counts[length]))
    return plan


def _place_udf(plan):
    @F.pandas_udf("sequence_id long, offset long")
    def place(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        rows = plan.value
        keys = (rows[:, 0] << _RANK_BITS) | rows[:, 1]
        for length, rank in batches:
            n, r = length.to_numpy(), rank.to_numpy()
            at = rows[np.searchsorted(keys, (n << _RANK_BITS) | r, "right") - 1]
            i = r - at[:, 1]
            yield pd.DataFrame({"sequence_id": at[:, 2] + i // at[:, 3], "offset": at[:, 4] + i % at[:, 3] * n})
    return place


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """``pieces`` (with a column ``length``) and their sequence_id and offset."""
    spark = pieces.sparkSession
    kept = cut(pieces)
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in kept.groupBy("length").count().collect():  # as many rows as lengths
        counts[length] = n
    total = int(counts.sum())
    plan = plan_packing(counts, capacity, groups)
    rows = np.array(sorted(plan.rows), np.int64).reshape(-1, 5)
    # the row number is fixed by the checkpoint; groups and offsets grow with the square root of the pieces
    parts = math.isqrt(total) + 1
    dealt = kept.withColumn("__row", F.monotonically_increasing_id()) \
        .withColumn("__part", F.pmod(F.xxhash64("__row"), F.lit(parts)).cast("int"))
    sums = dealt.groupBy("length", "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("length").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("length", "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy("length", "__part").orderBy("__row"))
    ranked = dealt.withColumn("__own", own).join(sums, ["length", "__part"])
    place = _place_udf(spark.sparkContext.broadcast(rows))
    return ranked.withColumn("__at", place("length", F.col("__before") + F.col("__own") - 1)) \
        .select(*pieces.columns, "__at.sequence_id", "__at.offset")


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                   capacity: int = CAPACITY, end_id: int = END_ID, groups: int = GROUPS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece."""
    return pack_pieces(cut_pieces(docs, tokenizer, id_col, text_col, capacity, end_id), capacity, groups)
