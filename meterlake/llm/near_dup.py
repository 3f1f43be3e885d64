"""MinHash near-dedup: SuperMinHash signatures, banding, exact verification, union-find.

1. Every document becomes its set of distinct word shingles (64-bit keys). Documents with
   the same set form one class, found by a 128-bit fingerprint of the set and combined
   map-side, so thousands of exact copies cost one representative.
2. A SuperMinHash signature (one correlated permutation per element, early stop) is cut
   into bands; representatives that share a band are candidates.
3. In every bucket the first member is compared with the others; links are confirmed on
   the full sets with ``intersection * 100 >= threshold * union``.
4. Links are grouped by star contraction (distributed union-find). In buckets that still
   hold several groups, each member outside the largest group is compared with a member of
   it, drawn anew for every bucket; so a bucket of near copies costs a few linear passes.
   Then all remaining pairs of different groups in a bucket are compared by their
   signatures, in bounded blocks, and those that agree like similar sets are confirmed
   there. Pairs inside one group are never built, and only links leave a block.

With 40 bands of 6 slots a pair at similarity 0.80 shares no band with probability 5e-6.

Defined results: NULL or blank texts have 0 shingles, form their own component and are
kept; texts shorter than the shingle are one shingle; repeated rows share a component and
are all marked kept when they carry its smallest id; a NULL id never wins over a non-NULL
one; only the id and the text column are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.llm.common import WordHash, blank_words, cut, mix64, shingle_keys, unused

BANDS, ROWS, SHINGLE = 40, 6, 5
#: Elements whose permutations are held at once (bytes = elements * slots).
CHUNK = 100_000
#: Rounds that compare with the largest group of a bucket before the exhaustive one.
TURNS = 1
#: Members of a bucket in one block of the exhaustive round.
PAIR_BLOCK = 1024
#: Shingles of such a block, about.
BLOCK_SHINGLES = 500_000

_U = np.uint64


def superminhash(keys: np.ndarray, doc: np.ndarray, n_docs: int, m: int, h: np.ndarray | None = None) -> np.ndarray:
    """Signatures (n_docs x m, uint64) of the element sets given as (key, doc) pairs.

    Each element walks a random permutation of the slots (Fisher-Yates, seeded by the
    element); at step j it offers ``j + u`` to its j-th slot. A document stops once all
    its slots hold values of an earlier step. Values are 32.32 fixed point, so equal
    inputs give equal bits. ``h`` continues an earlier call on the same documents."""
    h = np.full((n_docs, m), np.iinfo(np.uint64).max, np.uint64) if h is None else h
    flat = h.reshape(-1)
    perm = np.empty((len(keys), m), np.uint8 if m <= 256 else np.uint16)
    perm[:] = np.arange(m, dtype=perm.dtype)
    live = np.arange(len(keys))
    with np.errstate(over="ignore"):
        for j in range(m):
            if not len(live):
                break
            r = mix64(keys[live] + _U(j + 1) * _U(0x9E3779B97F4A7C15))
            k = (j + (((r & _U(0xFFFFFFFF)) * _U(m - j)) >> _U(32)).astype(np.int64))
            slot = perm[live, k]
            perm[live, k] = perm[live, j]
            np.minimum.at(flat, doc[live] * m + slot, (_U(j) << _U(32)) | (r >> _U(32)))
            here = np.unique(doc[live])
            open_docs = np.zeros(n_docs, bool)
            open_docs[here] = (h[here].max(axis=1) >> _U(32)) > _U(j)
            live = live[open_docs[doc[live]]]
    return h


def _signatures(sets: list[np.ndarray], m: int) -> np.ndarray:
    out = np.empty((len(sets), m), np.uint64)
    at = 0
    while at < len(sets):
        end, total = at, 0
        while end < len(sets) and (end == at or total + len(sets[end]) <= CHUNK):
            total += len(sets[end])
            end += 1
        keys = np.concatenate(sets[at:end]) if end > at else np.empty(0, np.uint64)
        doc = np.repeat(np.arange(end - at), [len(s) for s in sets[at:end]])
        h = None
        for i in range(0, max(len(keys), 1), CHUNK):
            h = superminhash(keys[i:i + CHUNK], doc[i:i + CHUNK], end - at, m, h)
        out[at:end] = h
        at = end
    return out


def _band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        parts = sig.reshape(len(sig), bands, rows)
        key = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(sig), 1))
        for t in range(rows):
            key = mix64(key * _U(0xD1342543DE82EF95) + parts[:, :, t])
    return key.view(np.int64)


def _fingerprint(keys: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(keys.tobytes())


def signature_udf(shingle: int, bands: int, rows: int):
    @F.pandas_udf("n long, fp binary, bands array<long>, sketch binary")
    def signature(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        memo = WordHash()
        for batch in texts:
            ns, fps, keys, sketches = [], [], [], []
            for at in range(0, len(batch), 256):
                sets = [shingle_keys(memo.array(blank_words(t)), shingle) for t in batch.iloc[at:at + 256]]
                sig = _signatures(sets, bands * rows)
                b = _band_keys(sig, bands, rows)
                ns += [len(s) for s in sets]
                fps += [_fingerprint(s) if len(s) else None for s in sets]
                keys += [x if len(s) else None for x, s in zip(b, sets, strict=True)]
                low = (sig & _U(255)).astype(np.uint8)
                sketches += [x.tobytes() if len(s) else None for x, s in zip(low, sets, strict=True)]
            yield pd.DataFrame({"n": ns, "fp": fps, "bands": keys, "sketch": sketches})
    return signature


def _fingerprint_udf(shingle: int):
    @F.pandas_udf("binary")
    def fingerprint(texts: pd.Series) -> pd.Series:
        memo = WordHash()
        sets = (shingle_keys(memo.array(blank_words(t)), shingle) for t in texts)
        return pd.Series([_fingerprint(s) if len(s) else None for s in sets])
    return fingerprint


def _set_udf(shingle: int):
    @F.pandas_udf("fp binary, keys array<long>")
    def full_set(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        memo = WordHash()
        for batch in texts:
            sets = [shingle_keys(memo.array(blank_words(t)), shingle) for t in batch]
            yield pd.DataFrame({"fp": [_fingerprint(s) for s in sets], "keys": [s.view(np.int64) for s in sets]})
    # evaluated once, above the join that leaves only the candidates
    return full_set.asNondeterministic()


def group_links(links: DataFrame) -> DataFrame:
    """Connected components of links (a, b): rows (node, root), root = smallest node.

    Alternating large-star and small-star contraction: minima are partial aggregates and
    every edge moves to a smaller node, so a hub of any degree is never gathered."""
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        edges = cut(small.select(F.col("v").alias("u"), F.col("m").alias("v"))
                    .unionAll(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def _similar(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a, b) whose full sets reach the threshold."""
    joined = pairs.join(sets.select(F.col("node").alias("a"), F.col("keys").alias("ka")), "a") \
        .join(sets.select(F.col("node").alias("b"), F.col("keys").alias("kb")), "b")
    both = F.size(F.array_intersect("ka", "kb"))
    return joined.withColumn("both", both) \
        .where(F.col("both") * 100 >= (F.size("ka") + F.size("kb") - F.col("both")) * threshold).select("a", "b")


def _fits(a: str, b: str, threshold: int):
    """Size bound: sets of such sizes can reach the threshold at all."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * threshold


def _largest_group_pairs(members: DataFrame, threshold: int, turn: int) -> DataFrame:
    """Every member outside its bucket's largest group against one member of that group, drawn anew each turn."""
    groups = members.groupBy("key", "root").agg(F.count("*").alias("size"), F.min_by(
        F.struct("node", "n"), F.xxhash64("node", "key", F.lit(turn))).alias("one"))
    largest = groups.groupBy("key").agg(F.max_by(F.struct("root", "one"), "size").alias("top"), F.count("*").alias("groups")) \
        .where("groups > 1").select("key", F.col("top.root").alias("top_root"), F.col("top.one.node").alias("a"), F.col("top.one.n").alias("na"))
    return members.join(largest, "key").where((F.col("root") != F.col("top_root")) & _fits("n", "na", threshold)) \
        .select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct()


def _alike(threshold: int, slots: int):
    """Links of a bucket's block pair: pairs whose signatures agree as those of similar sets
    do, confirmed on the full sets where they lie, so that only links leave the block.

    The agreement of ``slots`` slots (one byte each) has a variance of t(1-t)/slots at most,
    and of half that for sets smaller than the signature, as its slots are correlated. At
    4.5 deviations below the threshold a link is missed with probability 3e-6."""
    t = threshold / 100
    spread = 4.5 * (t * (1 - t) / slots) ** 0.5

    def alike(pdf: pd.DataFrame) -> pd.DataFrame:
        lo, hi = pdf["lo"].iloc[0], pdf["hi"].iloc[0]
        left, right = (pdf[pdf["block"] == x] for x in (lo, hi))
        a, b = (np.frombuffer(b"".join(x["sketch"]), np.uint8).reshape(len(x), slots) for x in (left, right))
        na, nb, ra, rb, ia, ib = (x[c].to_numpy() for c in ("n", "root", "node") for x in (left, right))
        ka, kb = left["keys"].to_list(), right["keys"].to_list()
        out = []
        for i in range(0, len(a), 64):
            rows = slice(i, i + 64)
            ok = (ra[rows, None] != rb) & (np.minimum(na[rows, None], nb) * 100 >= np.maximum(na[rows, None], nb) * threshold)
            if lo == hi:
                ok &= ia[rows, None] < ib
            x, y = np.nonzero(ok)
            for at in range(0, len(x), 65536):
                p, q = x[at:at + 65536] + i, y[at:at + 65536]
                small = na[p] + nb[q] <= slots
                good = (a[p] == b[q]).sum(axis=1) >= (t - spread * np.where(small, 0.5 ** 0.5, 1.0)) * slots
                p, q = p[good], q[good]
                for one in np.unique(p):  # one set against all its partners
                    with_ = q[p == one]
                    sizes = nb[with_]
                    both = np.add.reduceat(np.isin(np.concatenate([kb[j] for j in with_]), ka[one]).astype(np.int64),
                                           np.concatenate([[0], np.cumsum(sizes)[:-1]]))
                    linked = with_[both * 100 >= (na[one] + sizes - both) * threshold]
                    out.append(np.column_stack([np.full(len(linked), ia[one]), ib[linked]]))
        found = np.concatenate(out) if out else np.empty((0, 2), np.int64)
        return pd.DataFrame({"a": found.min(axis=1), "b": found.max(axis=1)} if len(found) else {"a": [], "b": []}).astype("int64")
    return alike


def _links_between_groups(members: DataFrame, sketches: DataFrame, sets: DataFrame, threshold: int, slots: int) -> DataFrame:
    """Links between different groups of a bucket, block against block."""
    sizes = members.groupBy("key").agg(F.ceil(F.greatest(F.count("*") / PAIR_BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    held = members.join(sizes, "key").join(sketches, "node").join(sets, "node") \
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return held.select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "node", "n", "root", "sketch", "keys") \
        .groupBy("key", "lo", "hi").applyInPandas(_alike(threshold, slots), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    threshold: int = 80, bands: int = BANDS, rows: int = ROWS, with_fp: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per document row (and ``fp``, the fingerprint of its set)."""
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = cut(ids.withColumn("s", signature_udf(shingle, bands, rows)("text")).select("doc_id", "s.n", "s.fp", "s.bands", "s.sketch"))
    # the node number is fixed by the checkpoint
    classes = cut(signed.where("fp is not null").groupBy("fp")
                  .agg(F.min("doc_id").alias("first_id"), F.first("n").cast("int").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
                  .withColumn("node", F.monotonically_increasing_id()))
    # one exchange serves the bucket totals and the join that drops buckets of one member
    cells = classes.select(F.explode("bands").alias("key"), "node", "n").repartition("key")
    shared = cells.groupBy("key").agg(F.count("*").alias("members"), F.min(F.struct("node", "n")).alias("c")).where("members > 1") \
        .select("key", "members", F.col("c.node").alias("centre"), F.col("c.n").alias("centre_n"))
    cells = cut(cells.join(shared, "key"))
    tested = cut(cells.where((F.col("node") != F.col("centre")) & _fits("n", "centre_n", threshold))
                 .select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct())
    roots = None
    if not tested.isEmpty():
        need = cut(classes.join(cells.select("node").distinct(), "node", "left_semi").select("node", "fp", "first_id"))
        texts = ids.join(need.select(F.col("first_id").alias("want")).distinct(), F.col("doc_id").eqNullSafe(F.col("want")), "left_semi")
        sets = cut(texts.select(_set_udf(shingle)("text").alias("s")).select("s.fp", "s.keys").join(need, "fp")
                   .groupBy("node").agg(F.first("keys").alias("keys")))
        links = cut(_similar(tested, sets, threshold))
        roots = group_links(links)
        wide = cells.where("members > 2").select("key", "node", "n")
        for turn in range(TURNS + 1):
            members = wide.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
            split = members.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
            wide = cut(members.join(split, "key", "left_semi"))
            if turn == TURNS:
                more = _links_between_groups(wide, classes.select("node", "sketch"), sets, threshold, bands * rows)
            else:
                pairs = cut(_largest_group_pairs(wide, threshold, turn).join(tested, ["a", "b"], "left_anti"))
                more = _similar(pairs, sets, threshold)
            more = cut(more)
            wide = wide.select("key", "node", "n")
            if not more.isEmpty():
                links = cut(links.unionAll(more))
                roots = group_links(links)
    named = classes.select("fp", "node", "first_id")
    if roots is not None:
        named = named.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
        named = named.join(least, "root").select("fp", "component_id")
    else:
        named = named.select("fp", F.col("first_id").alias("component_id"))
    out = signed.select("doc_id", F.col("n").alias("n_shingles"), "fp").join(named, "fp", "left")
    component = F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.col("doc_id").eqNullSafe(component).alias("kept"), *(["fp"] if with_fp else []))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """One row of each component, with all its columns; rows without words or without an id stay.

    A component keeps its smallest id; where rows of that id have other texts, too, they belong
    to other components and stay. Only the removed ids and the (few) ids that occur on several
    rows are joined back, the latter with the fingerprint of their set."""
    shingle = kw.get("shingle", SHINGLE)
    own, dup, mark = (unused(docs, name) for name in ("own", "id", "fp"))
    found = cut(near_duplicates(docs, id_col, text_col, **kw, with_fp=True)).where("doc_id is not null")
    several = cut(found.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select(F.col("doc_id").alias(dup)))
    key = F.col(id_col).cast("long") == F.col(dup)
    gone = found.where("not kept").select(F.col("doc_id").alias(dup)).distinct().join(several, dup, "left_anti")
    single = docs.join(gone, key, "left_anti")
    if several.isEmpty():
        return single
    # of such an id, one row of the component it stands for stays, and the rows without words
    keep = found.where("kept and fp is not null").join(several, F.col("doc_id") == F.col(dup), "left_semi") \
        .groupBy(F.col("doc_id").alias(dup)).agg(F.min("fp").alias(mark))
    many = docs.join(several, key, "left_semi").select(F.struct(*docs.columns).alias(own), F.col(id_col).cast("long").alias(dup),
                                                       _fingerprint_udf(shingle)(F.col(text_col)).alias(mark))
    blank = many.where(F.col(mark).isNull())
    worded = many.where(F.col(mark).isNotNull()).join(keep, [dup, mark], "left_semi").dropDuplicates([dup, mark])
    return single.join(several, key, "left_anti").unionByName(worded.unionByName(blank).select(f"{own}.*"))
