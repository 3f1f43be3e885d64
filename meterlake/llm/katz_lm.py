"""Language-model scoring by Katz backoff: Good-Turing discounted bigrams over unigrams with
exactly normalised backoff weights.

    P(w | h) = d(c(h,w)) c(h,w) / c(h)        if h,w was seen in training
             = alpha(h) P(w)                  otherwise (alpha = 1 for an unseen h)
    alpha(h) = (1 - sum of P(w | h) over seen w) / (1 - sum of P(w) over the same w)

d(r) is Katz's discount for r <= 5; larger counts give up ``KEPT`` of one count, so every
history keeps mass for unseen words. Unigrams are discounted alike and their rest is the
probability of an unknown word.

The counts are kept as packed, hash-partitioned tables: a block of documents is reduced to its
distinct bigrams (sorted by word and history, with the documents they occur in) and dealt out
by word. One shuffle serves two passes: the first gathers the counts of counts and a
fixed-size bit filter of the histories whose backoff weight is needed, the second emits per
document sums and, by history, the two sums of alpha. A second, small shuffle by history
turns those into weights for the unseen bigrams. Nothing of the vocabulary passes the
driver; a full bit filter only means that more histories are sent.

Defined results: NULL and empty texts are one end token; rows with a NULL id are scored but
not learned from; with no training text the base counts are zero and the score uses an
unknown-word probability of one; repeated rows are learned from and scored each; only id and
text are read, so other columns may have any names; very long texts make a block of their own.
"""

from __future__ import annotations

import math
import pickle
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.llm.common import WordHash, blank_words, id_bucket, mix64

#: Tokens of one block, input bytes that one partition of the counts stands for, largest discounted count.
BLOCK_TOKENS, TABLE_BYTES, MAX_R = 1_000_000, 20 << 20, 5
#: Part of a count that counts above MAX_R give to unseen words.
KEPT = 0.05
#: Bits of the filter of histories.
FILTER_BITS = 1 << 22

_U = np.uint64
END = np.uint64(xxhash.xxh3_64_intdigest(b"end", seed=1))
BEGIN = np.uint64(xxhash.xxh3_64_intdigest(b"begin", seed=1))


def _bit(h: np.ndarray) -> np.ndarray:
    return (mix64(h ^ _U(0x5851F42D4C957F2D)) % _U(FILTER_BITS)).astype(np.int64)


def _pack_block(block: int, ids: list, held: list, train: list, docs: list[np.ndarray], parts: int) -> Iterator[tuple[int, bytes]]:
    """One payload per partition: distinct (word, history) pairs and the documents of each occurrence."""
    sizes = np.array([len(d) for d in docs])
    word = np.concatenate(docs)
    doc = np.repeat(np.arange(len(docs), dtype=np.uint32), sizes)
    before = np.empty_like(word)
    before[1:] = word[:-1]
    before[np.concatenate([[0], np.cumsum(sizes)[:-1]])] = BEGIN
    part = (word % _U(parts)).astype(np.int64)
    order = np.lexsort((before, word, part))
    part, word, before, doc = part[order], word[order], before[order], doc[order]
    first = np.ones(len(word), bool)
    first[1:] = (word[1:] != word[:-1]) | (before[1:] != before[:-1])
    start = np.flatnonzero(first)
    times = np.diff(np.append(start, len(word)))
    new_word = np.ones(len(start), bool)
    new_word[1:] = word[start][1:] != word[start][:-1]
    edges = np.searchsorted(part, np.arange(parts + 1))
    key_edges = np.searchsorted(start, edges)
    small = np.uint16 if len(docs) < 65536 else np.uint32
    flags = np.array(train, bool)
    for p in range(parts):
        keys = slice(key_edges[p], key_edges[p + 1])
        if p and key_edges[p] == key_edges[p + 1]:
            continue
        at = np.flatnonzero(new_word[keys])
        n = key_edges[p + 1] - key_edges[p]
        yield p, pickle.dumps((block, word[start[keys]][at], np.diff(np.append(at, n)).astype(np.uint32), before[start[keys]],
                               times[keys].astype(np.uint32), doc[edges[p]:edges[p + 1]].astype(small), np.packbits(flags), len(docs),
                               (ids, held, sizes.tolist()) if p == 0 else None), protocol=5)


def _pack(parts: int):
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo, made = WordHash(), 0
        ids, held, train, docs, size = [], [], [], [], 0

        def flush():
            nonlocal made, ids, held, train, docs, size
            rows = list(_pack_block((TaskContext.get().partitionId() << 32) + made, ids, held, train, docs, parts))
            made += 1
            ids, held, train, docs, size = [], [], [], [], 0
            return pd.DataFrame(rows, columns=["part", "payload"])

        for batch in batches:
            for i, is_held, is_train, text in zip(batch["doc_id"], batch["held"], batch["train"], batch["text"], strict=True):
                d = np.append(memo.array(blank_words(text)), END)
                ids.append(None if pd.isna(i) else int(i))
                held.append(bool(is_held))
                train.append(bool(is_train))
                docs.append(d)
                size += len(d)
                if size >= BLOCK_TOKENS:
                    yield flush()
        if docs:
            yield flush()
    return pack


class _Table:
    """Counts of one partition, merged from its blocks."""

    def __init__(self, payloads: list[bytes]):
        self.blocks = []
        while payloads:  # the packed form goes as the arrays come
            self.blocks.append(pickle.loads(payloads.pop()))
        words, keys, trained = [], [], []
        for _, w, n, h, times, doc, flags, size, _ in self.blocks:
            word = np.repeat(w, n)
            words.append(word)
            with np.errstate(over="ignore"):
                keys.append(mix64(word * _U(0x9E3779B97F4A7C15) + mix64(h)))
            mine = np.unpackbits(flags, count=size)[doc].astype(np.int64)
            total = np.concatenate([[0], np.cumsum(mine)])
            end = np.cumsum(times.astype(np.int64))
            trained.append(total[end] - total[end - times])
        self.edges = np.cumsum([0] + [len(k) for k in keys])
        trained = np.concatenate(trained)
        self.word, at = np.unique(np.concatenate(words), return_inverse=True)
        self.word_at = at.astype(np.int32)
        del words, at
        _, first, at = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        self.first, self.key_at = first, at.astype(np.int32)
        del keys, at
        self.word_count = np.bincount(self.word_at, weights=trained, minlength=len(self.word)).astype(np.int64)
        self.key_count = np.bincount(self.key_at, weights=trained, minlength=len(first)).astype(np.int64)

    def history(self) -> np.ndarray:
        return np.concatenate([b[3] for b in self.blocks])


def _by_part(rows: Iterator[tuple]) -> Iterator[tuple[int, list]]:
    groups = defaultdict(list)
    for k, v in rows:
        groups[k].append(v)
    while groups:
        yield groups.popitem()


def _gather(rows: Iterator[tuple]) -> Iterator[dict]:
    """Counts of counts, and the filter of histories with unseen followers."""
    out = {"words": np.zeros(MAX_R + 2, np.int64), "pairs": np.zeros(MAX_R + 2, np.int64), "tokens": 0, "types": 0, "ends": 0,
           "filter": np.zeros(FILTER_BITS // 8, np.uint8)}
    for _, payloads in _by_part(rows):
        t = _Table(payloads)
        for name, counts in (("words", t.word_count), ("pairs", t.key_count)):
            out[name] += np.bincount(np.minimum(counts, MAX_R + 2), minlength=MAX_R + 3)[1:MAX_R + 3] * (np.arange(1, MAX_R + 3) < MAX_R + 2)
        out["tokens"] += int(t.word_count.sum())
        out["types"] += int((t.word_count > 0).sum())
        out["ends"] += int(t.word_count[t.word == END].sum())
        bits = np.zeros(FILTER_BITS, bool)
        bits[_bit(t.history()[t.key_count[t.key_at] == 0])] = True
        out["filter"] |= np.packbits(bits)
    yield out


def _merge(a: dict, b: dict) -> dict:
    return {k: a[k] | b[k] if k == "filter" else a[k] + b[k] for k in a}


def discounts(n: np.ndarray) -> np.ndarray:
    """Discounted counts of 1..MAX_R, from the numbers n[r-1] of items seen r times.

    Katz's formula; half a count less where its counts are missing or its value leaves (0, 1),
    as it does when many texts are copies."""
    r = np.arange(1, MAX_R + 1)
    plain = r - 0.5
    if (n[:MAX_R + 1] <= 0).any():
        return plain
    top = (MAX_R + 1) * n[MAX_R] / n[0]
    d = ((r + 1) * n[1:MAX_R + 1] / (r * n[:MAX_R]) - top) / (1 - top) if top < 1 else np.zeros(MAX_R)
    return np.where((d > 0) & (d < 1), r * d, plain)


def _discounted(counts: np.ndarray, low: np.ndarray) -> np.ndarray:
    return np.where(counts > MAX_R, counts - KEPT, np.append(0.0, low)[np.minimum(counts, MAX_R)])


def _score(stats, parts: int):
    """Per block and partition: sums per document; per history: sums of alpha and unseen bigrams."""
    def score(rows: Iterator[tuple]) -> Iterator[tuple]:
        s = stats.value
        wanted = np.unpackbits(s["filter"]).astype(bool)
        n = max(s["tokens"], 1)
        for _, payloads in _by_part(rows):
            t = _Table(payloads)
            uni = _discounted(t.word_count, s["word_low"]) / n
            log_uni = np.log10(np.where(uni > 0, uni, s["unknown"]))
            log_base = np.log10(t.word_count + 0.1)
            log_count = np.where((t.word_count > 0) & (t.word != END), np.log10(np.maximum(t.word_count, 1)), 0.0)
            kept = _discounted(t.key_count, s["pair_low"])
            log_kept = np.log10(np.where(kept > 0, kept, 1.0))
            history = t.history()
            # by history: seen followers' mass and lower-order mass, and the history's own count
            h, w, c = history[t.first], t.word_at[t.first], t.key_count
            use = (c > 0) & wanted[_bit(h)]
            hs, at = np.unique(h[use], return_inverse=True)
            own = wanted[_bit(t.word)] & (t.word_count > 0) & (t.word != END)
            send = (np.concatenate([hs, t.word[own]]), np.concatenate([np.bincount(at, weights=kept[use], minlength=len(hs)), np.zeros(own.sum())]),
                    np.concatenate([np.bincount(at, weights=uni[w[use]], minlength=len(hs)), np.zeros(own.sum())]),
                    np.concatenate([np.zeros(len(hs), np.int64), t.word_count[own]]))
            target = (send[0] % _U(parts)).astype(np.int64)
            for p in np.unique(target):
                yield int(p), ("alpha", *(x[target == p] for x in send))
            for i, (block, _, _, h, times, doc, _, size, meta) in enumerate(t.blocks):
                mine = slice(t.edges[i], t.edges[i + 1])
                key, word = t.key_at[mine], t.word_at[mine]
                per = np.repeat(np.arange(len(times)), times)
                total = lambda v: np.bincount(doc, weights=v[per], minlength=size)  # noqa: E731, B023
                yield -1 - block, ("docs", total(log_base[word]), total(log_kept[key] - log_count[word]),
                                   total((t.word_count[word] > 0).astype(float)).astype(np.uint32), meta)
                unseen = np.flatnonzero(t.key_count[key][per] == 0)
                if len(unseen):
                    k = per[unseen]
                    target = (h[k] % _U(parts)).astype(np.int64)
                    for p in np.unique(target):
                        here = target == p
                        yield int(p), ("unseen", block, h[k][here], doc[unseen][here], log_uni[word[k]][here])
    return score


def _back_off(stats):
    """Backoff weights by history, applied to the unseen bigrams; document sums pass through."""
    def back_off(rows: Iterator[tuple]) -> Iterator[tuple]:
        s = stats.value
        for key, values in _by_part(rows):
            if key < 0:
                for v in values:
                    yield key, v
                continue
            alpha, unseen = [v[1:] for v in values if v[0] == "alpha"], [v[1:] for v in values if v[0] == "unseen"]
            if not unseen:
                continue
            hs = np.concatenate([u[1] for u in unseen])
            hist, at = np.unique(np.concatenate([*(a[0] for a in alpha), hs]), return_inverse=True)
            n = sum(len(a[0]) for a in alpha)
            sums = [np.bincount(at[:n], weights=np.concatenate([a[k] for a in alpha]), minlength=len(hist)) if n else np.zeros(len(hist))
                    for k in (1, 2, 3)]
            count = np.where(hist == BEGIN, s["ends"], sums[2])
            known = (count > 0) & (sums[0] > 0)
            left = np.where(known, 1 - sums[0] / np.maximum(count, 1), 1.0)
            weight = np.where(known, np.log10(np.maximum(left, 1e-300)) - np.log10(np.maximum(1 - sums[1], 1e-300)), 0.0)
            # the document sums already hold -log10 c(h) for every known history
            back = weight + np.log10(np.maximum(count, 1))
            edge = n
            for block, h, doc, low in unseen:
                value = back[at[edge:edge + len(h)]] + low
                edge += len(h)
                docs, where = np.unique(doc, return_inverse=True)
                yield -1 - block, ("more", docs, np.bincount(where, weights=value))
    return back_off


def _finish(stats):
    def finish(rows: Iterator[tuple]) -> Iterator[tuple]:
        s = stats.value
        norm = math.log10(s["tokens"] + 0.1 * (s["types"] + 1))
        begin = math.log10(max(s["ends"], 1))
        for _, values in _by_part(rows):
            base = score = known = meta = None
            for v in (v for v in values if v[0] == "docs"):
                base, score, known = (v[1], v[2], v[3].astype(np.int64)) if base is None else (base + v[1], score + v[2], known + v[3])
                meta = v[4] or meta
            for v in (v for v in values if v[0] == "more"):
                score[v[1]] += v[2]
            ids, held, sizes = meta
            for i in range(len(ids)):
                yield (ids[i], held[i], sizes[i], int(known[i]), s["tokens"], float(base[i] - sizes[i] * norm), float(score[i] - begin))
    return finish


def score_texts(docs: DataFrame, train, held, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; ``train`` and ``held`` are conditions."""
    spark = docs.sparkSession
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held, F.lit(False)).alias("held"),
                        F.coalesce(train, F.lit(False)).alias("train"), F.col(text_col).alias("text"))
    size = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(4, -(-int(size) // TABLE_BYTES))
    same = lambda k: k
    packed = named.mapInPandas(_pack(parts), "part int, payload binary").rdd.map(lambda r: (r[0], bytes(r[1])))
    tables = packed.partitionBy(parts, same)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    stats = tables.mapPartitions(_gather).treeReduce(_merge)
    stats["word_low"], stats["pair_low"] = discounts(stats["words"]), discounts(stats["pairs"])
    n = stats["tokens"]
    # mass that the discounts take from the unigrams
    lost = sum(stats["words"][r - 1] * (r - stats["word_low"][r - 1]) for r in range(1, MAX_R + 1))
    more = stats["types"] - int(stats["words"][:MAX_R].sum())
    stats["unknown"] = float(lost + KEPT * more) / n if n else 1.0
    sent = spark.sparkContext.broadcast(stats)
    # keys below zero are blocks, others partitions of histories
    spread = lambda k: k if k >= 0 else hash(-1 - k)
    dealt = tables.mapPartitions(_score(sent, parts)).partitionBy(parts, spread)
    done = dealt.mapPartitions(_back_off(sent)).partitionBy(parts, spread).mapPartitions(_finish(sent))
    return spark.createDataFrame(done, schema)


def language_model_report(docs: DataFrame, folds: int = 10, held: int = 0) -> DataFrame:
    fold = id_bucket(F.col("doc_id"), folds)
    return score_texts(docs, fold != held, fold == held)
