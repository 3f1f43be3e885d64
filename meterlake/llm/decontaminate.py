"""Benchmark decontamination: suffix arrays over training shards, searched by every test suffix.

A shard is one Arrow batch of documents. Its words become ids of the benchmark's
vocabulary (0: not in it) and its suffix array sorts the word positions by the ids that
follow, up to the longest test item. Every suffix of every test item is located in it by
binary search; the neighbours of the found place give the longest verbatim match, and the
equal range over the first ``window`` words gives all places of that window.

Positions inside a run of known words shorter than the shortest window cannot start a
match and stay out of the array; that bound is exact and leaves it small. Documents are
never shuffled: each shard is searched where it is read, so a passage in a third of all
documents costs nothing extra. The benchmark travels as broadcast blocks of about
``block_bytes`` of text each; a larger benchmark is searched block after block. A block is
one flat array of word ids and a few numbers per word, so its memory is linear in its words
however long an item is.

Defined results: NULL or word-less texts have no words and no hits; items without words
or with a NULL text have no window; an item with a NULL id hits words but is not counted
or listed; repeated items count once; only the text column is read, and other columns may
have any names; very long texts and items are searched whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.llm.common import cut, unused

WINDOW = 10
#: Benchmark text per broadcast block.
BLOCK_BYTES = 16 << 20

#: A-Z to a-z; every ASCII byte that is no letter or digit to a blank; bytes of other characters stay.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def item_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased."""
    return text.encode("utf-8", "replace").translate(_FOLD).split() if text else []


def pack_items(items: list[tuple[str | None, str | None]], window: int) -> dict:
    """The test side of the search: vocabulary, item ids, the word ids of all items one after
    another, and the end of its item and the words it needs for each test suffix (one per word)."""
    vocab: dict[bytes, int] = {}
    rows = sorted({(i is None, i or "", tuple(w)) for i, t in items if (w := item_words(t))})
    sizes = np.array([len(w) for *_, w in rows], np.int64)
    flat = np.fromiter((vocab.setdefault(w, len(vocab) + 1) for *_, words in rows for w in words), np.int32, int(sizes.sum()))
    stop = np.repeat(np.cumsum(sizes), sizes)
    size = np.repeat(np.minimum(sizes, window), sizes)
    return {"vocab": vocab, "names": [None if none else name for none, name, _ in rows], "flat": flat, "stop": stop, "begin": stop - np.repeat(sizes, sizes),
            "owner": np.repeat(np.arange(len(rows)), sizes), "need": np.where(np.arange(len(flat)) + size <= stop, size, 0),
            "depth": int(sizes.max(initial=0)), "least": int(np.minimum(sizes, window).min()) if len(rows) else 0}


def suffix_array(ids: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """``starts`` sorted by the ids that follow, to ``depth`` words or the first unknown one (prefix doubling)."""
    rank = ids.astype(np.int64)
    width = 1
    while width < depth:
        ahead = np.zeros_like(rank)
        ahead[:-width] = rank[width:] if width < len(rank) else 0
        ahead[rank == 0] = 0
        pair = rank * (int(rank.max(initial=0)) + 1) + ahead
        rank = np.unique(pair, return_inverse=True)[1].reshape(-1)
        if pair.min(initial=1) > 0:
            rank = rank + 1
        width *= 2
    return starts[np.lexsort((starts, rank[starts]))]


def _compare(ids: np.ndarray, at: np.ndarray, flat: np.ndarray, test: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Sign of (text suffix at ``at``) against the ``depth`` words of ``flat`` from ``test``; 0: it begins with them."""
    sign = np.zeros(len(at), np.int64)
    open_ = np.arange(len(at))
    for t in range(int(depth.max(initial=0))):
        open_ = open_[depth[open_] > t]
        if not len(open_):
            break
        diff = np.sign(ids[at[open_] + t] - flat[test[open_] + t])
        sign[open_] = diff
        open_ = open_[diff == 0]
    return sign


def _bound(ids: np.ndarray, sa: np.ndarray, flat: np.ndarray, test: np.ndarray, depth: np.ndarray, upper: bool) -> np.ndarray:
    """Binary search of all test suffixes at once."""
    lo, hi = np.zeros(len(test), np.int64), np.full(len(test), len(sa), np.int64)
    while True:
        open_ = np.flatnonzero(lo < hi)
        if not len(open_):
            return lo
        mid = (lo[open_] + hi[open_]) // 2
        sign = _compare(ids, sa[mid], flat, test[open_], depth[open_])
        right = sign <= 0 if upper else sign < 0
        lo[open_] = np.where(right, mid + 1, lo[open_])
        hi[open_] = np.where(right, hi[open_], mid)


def _common(ids: np.ndarray, at: np.ndarray, flat: np.ndarray, test: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Words that the text at ``at`` and each test suffix have in common."""
    n = np.zeros(len(at), np.int64)
    open_ = np.arange(len(at))
    for t in range(int(depth.max(initial=0))):
        open_ = open_[depth[open_] > t]
        open_ = open_[ids[at[open_] + t] == flat[test[open_] + t]]
        if not len(open_):
            break
        n[open_] += 1
    return n


def search_shard(texts: list, pack: dict) -> tuple[np.ndarray, list[tuple[int, int, int, int]], list[tuple[int, int, int]]]:
    """Words per document; window places (document, first word, words, item); longest matches
    (test suffix, words, document) of the shard, for suffixes that match at least their window."""
    return _search(texts, pack)[:3]


def _search(texts: list, pack: dict):
    """What ``search_shard`` tells, and the longest verbatim match of each document that has one:
    {document: (words, first word in it, item, first word in the item)}, the first one on ties."""
    get = pack["vocab"].get
    words = [item_words(t) for t in texts]
    counts = np.array([len(w) for w in words], np.int64)
    flat, least, depth = pack["flat"], pack["least"], pack["depth"]
    if not len(flat) or not counts.sum():
        return counts, [], [], {}
    begin = np.concatenate([[0], np.cumsum(counts + 1)])
    ids = np.zeros(begin[-1] + depth, np.int64)
    for b, w in zip(begin.tolist(), words, strict=False):
        ids[b:b + len(w)] = [get(x, 0) for x in w]
    stop = np.flatnonzero(ids == 0)
    known = np.flatnonzero(ids)
    run = stop[np.searchsorted(stop, known)] - known
    starts = known[run >= least]
    if not len(starts):
        return counts, [], [], {}
    # only the neighbourhoods of candidate positions take part in the sort
    keep = np.zeros(len(ids) + 1, np.int64)
    np.add.at(keep, starts, 1)
    np.add.at(keep, np.minimum(starts + run[run >= least], len(ids)), -1)
    spot = np.flatnonzero((np.cumsum(keep[:-1]) > 0) & (ids > 0))
    gaps = np.flatnonzero(np.diff(spot) > 1) + 1
    place = np.arange(len(spot)) + np.searchsorted(gaps, np.arange(len(spot)), side="right")
    dense = np.zeros(place[-1] + 1 + depth, np.int64)
    dense[place] = ids[spot]
    back = np.zeros(len(dense), np.int64)
    back[place] = spot
    sa = suffix_array(dense, place[np.isin(spot, starts, assume_unique=True)], depth)
    test = np.arange(len(flat))
    full = pack["stop"] - test
    at = _bound(dense, sa, flat, test, full, upper=False)
    after, before = np.minimum(at, len(sa) - 1), np.maximum(at - 1, 0)
    ahead = _common(dense, sa[after], flat, test, full)
    longest = np.maximum(ahead, _common(dense, sa[before], flat, test, full))
    near = np.where(ahead == longest, after, before)
    hit = np.flatnonzero((pack["need"] > 0) & (longest >= pack["need"]))
    lo, hi = (_bound(dense, sa, flat, hit, pack["need"][hit], upper=u) for u in (False, True))
    n = hi - lo
    which = np.repeat(hit, n)
    pos = back[sa[np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]] if len(hit) else np.empty(0, np.int64)
    doc = np.searchsorted(begin, pos, side="right") - 1
    places = list(zip(doc.tolist(), (pos - begin[doc]).tolist(), pack["need"][which].tolist(), pack["owner"][which].tolist(), strict=True))
    best = back[sa[near[hit]]]
    matches = list(zip(hit.tolist(), longest[hit].tolist(), (np.searchsorted(begin, best, side="right") - 1).tolist(), strict=True))
    # every longest match starts with a place of its first window, and goes on from there word by word
    extent = _common(ids, pos, flat, which, pack["stop"][which] - which)
    item, offset = pack["owner"][which], which - pack["begin"][which]
    order = np.lexsort((offset, item, pos, -extent, doc))
    order = order[np.flatnonzero(np.diff(doc[order], prepend=-1))]
    best_of = {d: row for d, *row in zip(*(x[order].tolist() for x in (doc, extent, pos - begin[doc], item, offset)), strict=True)}
    return counts, places, matches, best_of


def _covered(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


#: Words searched at once.
SHARD_WORDS = 400_000
#: The longest verbatim match: its words, its first word in the document, the item (NULL: an item
#: without an id) and its first word there.
MATCH = "struct<words:long,start:long,item:string,item_start:long>"


def _search_udf(packed):
    """Per document: n_words, merged hit spans (word offsets), items, the longest verbatim match."""
    @F.pandas_udf(f"n_words long, spans array<struct<a:long,b:long>>, items array<string>, match {MATCH}")
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        pack = packed.value
        for batch in batches:
            rows = []
            texts = batch.tolist()
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size < SHARD_WORDS * 6):
                    size += len(texts[end] or "")
                    end += 1
                counts, places, _, best = _search(texts[at:end], pack)
                spans: dict[int, list] = {}
                items: dict[int, set] = {}
                for d, a, n, item in places:
                    spans.setdefault(d, []).append((a, a + n))
                    items.setdefault(d, set()).add(pack["names"][item])
                for d, n in enumerate(counts.tolist()):
                    words, start, item, item_start = best.get(d, (0, None, None, None))
                    match = {"words": words, "start": start, "item": None if item is None else pack["names"][item], "item_start": item_start}
                    rows.append((n, _covered(spans.get(d, [])), sorted(x for x in items.get(d, ()) if x is not None), match))
                at = end
            yield pd.DataFrame({"n_words": [r[0] for r in rows], "spans": [[{"a": a, "b": b} for a, b in r[1]] for r in rows],
                                "items": [r[2] for r in rows], "match": [r[3] for r in rows]})
    return search


def _merge_udf():
    @F.pandas_udf("array<struct<a:long,b:long>>")
    def merge(spans: pd.Series) -> pd.Series:
        return pd.Series([[{"a": a, "b": b} for a, b in _covered([(x["a"], x["b"]) for x in s])] for s in spans])
    return merge


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple]]:
    """The benchmark in blocks of bounded text, read one at a time."""
    held = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).where("t is not null")
    total = held.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-int(total) * 2 // block_bytes)) if total > block_bytes else 1
    for k in range(n):
        part = held if n == 1 else held.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        yield [(r.i, r.t) for r in part.collect()]


def find_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id",
                       item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
                       result: str = "__leak") -> DataFrame:
    """``docs`` with a struct column ``result``: n_words, spans, items, match."""
    sc = docs.sparkSession.sparkContext
    more, joined = unused(docs, "more"), unused(docs, "joined")
    out = None
    for block in _blocks(benchmark, item_id, item_text, block_bytes):
        search = _search_udf(sc.broadcast(pack_items(block, window)))
        if out is None:
            out = docs.withColumn(result, search(F.col(text_col)))
            continue
        both = cut(out).withColumn(more, search(F.col(text_col)))
        spans = _merge_udf()(F.concat(f"{result}.spans", f"{more}.spans"))
        out = both.withColumn(joined, spans).withColumn(result, F.struct(
            F.col(f"{result}.n_words").alias("n_words"), F.col(joined).alias("spans"),
            F.array_sort(F.array_union(f"{result}.items", f"{more}.items")).alias("items"),
            F.when(F.col(f"{more}.match.words") > F.col(f"{result}.match.words"), F.col(f"{more}.match"))
            .otherwise(F.col(f"{result}.match")).alias("match"))).drop(more, joined)
    return out


def contamination_report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **kw) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest (words of the longest verbatim
    match), match (its places) and spans (merged hit words)."""
    found = find_contamination(docs.select(F.col(id_col).alias("doc_id"), F.col(kw.pop("text_col", "text")).alias("text")), benchmark, **kw)
    hit = F.aggregate("__leak.spans", F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"])
    return found.select(
        "doc_id", F.col("__leak.n_words").alias("n_words"), hit.alias("n_hit"),
        F.size("__leak.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("__leak.items", ",").cast("binary"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"), F.col("__leak.match.words").alias("longest"), F.col("__leak.match").alias("match"),
        F.col("__leak.spans").alias("spans"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """The documents without any benchmark window, with their columns."""
    leak = unused(docs, "leak")
    return find_contamination(docs, benchmark, result=leak, **kw).where(F.size(f"{leak}.spans") == 0).drop(leak)

