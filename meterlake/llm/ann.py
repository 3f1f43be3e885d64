"""Approximate nearest neighbours by largest inner product: hierarchical k-means tree,
best-bin-first traversal through a priority queue, leaf visits widened to a calibrated recall.

Vectors get one more component, sqrt(M^2 - |v|^2) with M the largest norm, so that the
nearest vector of a query is the one with the largest inner product. The tree is fitted on
a bounded sample (``sample_rows`` vectors with the smallest id hashes); every row is
indexed. Held-back sample queries tell how many leaves must be visited until ``target``
of their true neighbours are found; that number then holds for all queries, which also go
on until their leaves hold enough rows.

Leaves meet their queries in ``GROUPS`` groups of leaves, so that a query travels once per
group and not once per leaf. A group with more than twice its share of the rows (say, one
vector that a third of the rows share) is dealt over several cells, which each get its
queries; as only such groups are split, the copies stay in proportion. Within a cell, blocks
of about ``BLOCK`` rows meet blocks of about ``QUERY_BLOCK`` queries in one matrix product
each, of which the leaves that a query does not visit are left out. Each task keeps the
best k of each query, and the final choice reads only those.

Defined results: vectors that are NULL, zero, or hold a NULL or non-finite component take
no part, nor do vectors of another length than the most frequent one; rows without an id
take no part; rows that repeat an id are candidates each, but never for their own id;
ties go to the smaller id; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.llm.common import cut, sample_ids

SAMPLE_ROWS, LEAF, BRANCH = 16_384, 64, 8
BLOCK, QUERY_BLOCK, GROUPS = 2048, 1024, 64
TARGET, CALIBRATION = 0.96, 256
#: Rows of (query, candidate) that a task holds before it keeps the best k only.
HELD = 1_000_000


def _augment(v: np.ndarray, top: float) -> np.ndarray:
    return np.column_stack([v, np.sqrt(np.maximum(top - (v * v).sum(axis=1), 0.0))])


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Centres of at most k clusters (k-means++ seeds, 12 rounds)."""
    centres = [x[rng.integers(len(x))]]
    d = ((x - centres[0]) ** 2).sum(axis=1)
    while len(centres) < k and d.max() > 1e-12:
        centres.append(x[rng.choice(len(x), p=d / d.sum())])
        d = np.minimum(d, ((x - centres[-1]) ** 2).sum(axis=1))
    c = np.array(centres)
    for _ in range(12):
        near = _nearest(x, c)
        new = np.array([x[near == i].mean(axis=0) if (near == i).any() else c[i] for i in range(len(c))])
        if np.allclose(new, c):
            break
        c = new
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(axis=1)[None, :] - 2 * x @ c.T).argmin(axis=1)


def build_tree(x: np.ndarray, leaf: int = LEAF, branch: int = BRANCH, seed: int = 7) -> dict:
    """Nodes as (centres, children); a child below zero is leaf -1 - child."""
    rng = np.random.default_rng(seed)
    nodes: list = []
    leaves = 0

    def grow(rows: np.ndarray) -> int:
        nonlocal leaves
        if len(rows) > leaf:
            c = _kmeans(x[rows], branch, rng)
            near = _nearest(x[rows], c)
            used = np.unique(near)
            if len(used) > 1:
                at = len(nodes)
                nodes.append(None)
                nodes[at] = (c[used], [grow(rows[near == i]) for i in used])
                return at
        leaves += 1
        return -leaves

    root = grow(np.arange(len(x)))
    return {"nodes": nodes, "root": root, "leaves": leaves}


def assign(tree: dict, x: np.ndarray) -> np.ndarray:
    """Leaf of each row: the nearest centre at every level."""
    out = np.zeros(len(x), np.int64)
    todo = [(tree["root"], np.arange(len(x)))]
    while todo:
        at, rows = todo.pop()
        if at < 0 or not len(rows):
            out[rows] = -1 - at if at < 0 else 0
            continue
        c, children = tree["nodes"][at]
        near = _nearest(x[rows], c)
        todo += [(child, rows[near == i]) for i, child in enumerate(children)]
    return out


def best_bins(tree: dict, q: np.ndarray) -> Iterator[int]:
    """Leaves in the order of a best-bin-first search: the queue holds subtrees by the distance of their centre."""
    queue = [(0.0, tree["root"])]
    while queue:
        _, at = heapq.heappop(queue)
        while at >= 0:
            c, children = tree["nodes"][at]
            d = ((c - q) ** 2).sum(axis=1)
            near = int(d.argmin())
            for i, child in enumerate(children):
                if i != near:
                    heapq.heappush(queue, (float(d[i]), child))
            at = children[near]
        yield -1 - at


def calibrate(tree: dict, x: np.ndarray, raw: np.ndarray, k: int, target: float, n: int = CALIBRATION) -> int:
    """Leaves to visit until ``target`` of the sample queries' true neighbours are found."""
    home = assign(tree, x)
    some = np.linspace(0, len(x) - 1, min(n, len(x))).astype(int)
    found = np.zeros(tree["leaves"] + 1)
    for i in some:
        s = raw @ raw[i]
        s[i] = -np.inf
        best = np.argpartition(-s, min(k, len(s)) - 1)[:k] if len(s) > k else np.flatnonzero(s > -np.inf)
        q = x[i].copy()
        q[-1] = 0.0
        rank = np.zeros(tree["leaves"], np.int64)
        for r, leaf in enumerate(best_bins(tree, q)):
            rank[leaf] = r
        if len(best):
            found += np.bincount(rank[home[best]], minlength=len(found))
    total = np.cumsum(found)
    return int(np.searchsorted(total, target * total[-1])) + 1 if total[-1] else tree["leaves"]


def _matrix(rows) -> np.ndarray:
    return np.array([np.asarray(r, np.float64) for r in rows])


def _leaf_udf(tree, top: float):
    @F.pandas_udf("int")
    def leaf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vecs in batches:
            yield pd.Series(assign(tree.value, _augment(_matrix(vecs), top)) if len(vecs) else [], dtype="int32")
    return leaf


def _visit_udf(tree, visits: int, sizes: dict, enough: int):
    @F.pandas_udf("array<struct<group:int,leaves:array<int>>>")
    def visit(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vecs in batches:
            out = []
            for v in vecs:
                leaves, held = [], 0
                for leaf in best_bins(tree.value, np.append(np.asarray(v, np.float64), 0.0)):
                    if len(leaves) >= visits and held >= enough:
                        break
                    leaves.append(leaf)
                    held += sizes.get(leaf, 0)
                groups: dict = {}
                for x in leaves:
                    if sizes.get(x):
                        groups.setdefault(x % GROUPS, []).append(x)
                out.append([{"group": g, "leaves": x} for g, x in groups.items()])
            yield pd.Series(out)
    return visit


def _best(q: np.ndarray, v: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query among (query, candidate, score) rows."""
    order = np.lexsort((v, -s, q))
    q, v, s = q[order], v[order], s[order]
    first = np.concatenate([[True], q[1:] != q[:-1]]) if len(q) else np.empty(0, bool)
    rank = np.arange(len(q)) - np.maximum.accumulate(np.where(first, np.arange(len(q)), 0)) if len(q) else np.empty(0, int)
    keep = rank < k
    return q[keep], v[keep], s[keep]


def _visited(visits, leaves: np.ndarray) -> np.ndarray:
    """(query, row): does the query visit the leaf of the row."""
    some, at = np.unique(leaves, return_inverse=True)
    asked = np.concatenate([np.asarray(x, np.int64) for x in visits])
    query = np.repeat(np.arange(len(visits)), [len(x) for x in visits])
    place = np.minimum(np.searchsorted(some, asked), len(some) - 1)
    here = some[place] == asked
    out = np.zeros((len(visits), len(some)), bool)
    out[query[here], place[here]] = True
    return out[:, at]


def _score(k: int):
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list = []
        size = 0

        def flush():
            q, v, s = _best(*(np.concatenate(x) for x in zip(*held, strict=True)), k)
            return pd.DataFrame({"query_id": q, "vec_id": v, "score": s})

        for batch in batches:
            for r in batch.itertuples(index=False):
                qids, ids = np.asarray(r.query_ids, np.int64), np.asarray(r.ids, np.int64)
                q, v = _matrix(r.queries), _matrix(r.vecs)
                s = q @ v.T
                s[qids[:, None] == ids[None, :]] = -np.inf
                s[~_visited(r.visits, np.asarray(r.leaves, np.int64))] = -np.inf
                if len(ids) > k:  # the product may differ in the last bits between equal vectors
                    floor = -np.partition(-s, k - 1, axis=1)[:, k - 1]
                    a, b = np.nonzero(s >= (floor - 1e-9 * np.maximum(1.0, np.abs(floor)))[:, None])
                else:
                    a, b = np.nonzero(s > -np.inf)
                ok = s[a, b] > -np.inf
                a, b = a[ok], b[ok]
                exact = np.concatenate([np.einsum("ij,ij->i", q[a[i:i + 65536]], v[b[i:i + 65536]])
                                        for i in range(0, len(a), 65536)] or [np.empty(0)])
                held.append(_best(qids[a], ids[b], exact, k))
                size += len(held[-1][0])
                if size > HELD:
                    held = [_best(*(np.concatenate(x) for x in zip(*held, strict=True)), k)]
                    size = len(held[0][0])
                    if size > HELD // 2:
                        yield flush()
                        held, size = [], 0
        if held:
            yield flush()
    return score


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v) of the vectors that take part; single-precision vectors stay so until they are multiplied."""
    v = F.col("v")
    wide = "array<float>" if vectors.schema[vec_col].dataType.simpleString() == "array<float>" else "array<double>"
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast(wide).alias("v")) \
        .where(F.col("vec_id").isNotNull() & v.isNotNull()).where(finite & F.exists(v, lambda x: x != 0))
    sizes = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return good.where(F.size("v") == (sizes[0].d if sizes else 0))


def nearest(vectors: DataFrame, queries: DataFrame | None = None, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
            sample_rows: int = SAMPLE_ROWS, target: float = TARGET) -> DataFrame:
    """query_id, rank, vec_id, score: the k best found of each query; ``queries`` has the ids to search for (all, if None)."""
    spark = vectors.sparkSession
    good = usable(vectors, id_col, vec_col)
    top = good.agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))).first()[0]
    schema = "query_id long, vec_id long, score double"
    if top is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    some = sample_ids(good.select(F.col("vec_id").alias("id")).distinct(), sample_rows)
    raw = _matrix(r.v for r in good.join(F.broadcast(some), F.col("vec_id") == F.col("id"), "left_semi")
                  .orderBy("vec_id").limit(sample_rows).collect())
    x = _augment(raw, top)
    tree = build_tree(x)
    visits = calibrate(tree, x, raw, k, target)
    held = spark.sparkContext.broadcast(tree)
    indexed = cut(good.withColumn("leaf", _leaf_udf(held, top)("v")))
    # one row per leaf of the bounded tree
    sizes = {r.leaf: r["count"] for r in indexed.groupBy("leaf").count().collect()}
    group_rows: dict = {}
    for leaf, n in sizes.items():
        group_rows[leaf % GROUPS] = group_rows.get(leaf % GROUPS, 0) + n
    share = max(BLOCK, 2 * sum(sizes.values()) // GROUPS)
    cells = {g: -(-n // share) for g, n in group_rows.items()}
    of_group = lambda values: F.element_at(F.create_map(*[F.lit(y) for pair in values.items() for y in pair]), F.col("group"))
    parts = {g: cells[g] * -(-n // (cells[g] * BLOCK)) for g, n in group_rows.items()}
    blocks = indexed.withColumn("group", F.pmod("leaf", F.lit(GROUPS))) \
        .withColumn("part", F.pmod(F.xxhash64("vec_id"), of_group(parts)).cast("int")) \
        .withColumn("cell", F.pmod("part", of_group(cells))) \
        .groupBy("group", "cell", "part").agg(F.collect_list(F.struct("vec_id", "v", "leaf")).alias("rows"))
    asked = indexed if queries is None else indexed.join(queries.select(F.col(id_col).alias("vec_id")).distinct(), "vec_id", "left_semi")
    asked = cut(asked.select("vec_id", "v").dropDuplicates(["vec_id"]))
    n = max(1, -(-asked.count() // QUERY_BLOCK))
    visited = asked.repartition(n, "vec_id").select("vec_id", "v", F.explode(_visit_udf(held, visits, sizes, k + 1)("v")).alias("g")) \
        .select("vec_id", "v", "g.group", "g.leaves") \
        .withColumn("cell", F.explode(F.sequence(F.lit(0), of_group(cells) - 1))) \
        .withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n))) \
        .groupBy("group", "cell", "block").agg(F.collect_list(F.struct("vec_id", "v", "leaves")).alias("asked"))
    pairs = blocks.join(visited, ["group", "cell"]).select(
        F.col("asked.vec_id").alias("query_ids"), F.col("asked.v").alias("queries"), F.col("asked.leaves").alias("visits"),
        F.col("rows.vec_id").alias("ids"), F.col("rows.v").alias("vecs"), F.col("rows.leaf").alias("leaves"))
    found = pairs.mapInPandas(_score(k), schema)
    return found.withColumn("rank", F.expr("row_number() over (partition by query_id order by score desc, vec_id)")) \
        .where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
