"""Cross-tokenizer alignment: two token sequences of one text, matched by the bytes they end at.

1. A task reads documents, encodes them by a byte-level vocabulary (A, space + text) and a
   piece model (B, which adds the space), and takes the byte end of every token.
2. The shorter end list of a document drives a galloping search into the longer one:
   exponential steps from a first guess, then binary search in the bracket, for all tokens
   of a batch in lockstep. Common ends cut the text into groups; the differences of the
   ranks found are the ranges of the longer list that a token of the shorter one overlaps.
3. Links (overlapping A-B tokens) are counted per block of documents, blocks are summed over
   the corpus by id pair, and each block gets back the sums of its own pairs; so neither a
   broadcast nor a task ever holds the pairs of the corpus. A block keeps, packed, which of
   its pairs a document holds how often.

``align`` returns the counts and digests; ``groups_of`` and ``links_of`` give one text's
groups and links themselves.

Defined results: texts that are NULL or empty, or whose joined token bytes differ from
space + text on either side (a text with U+2581, for example), have no tokens: zeros and an
empty digest. Repeated rows and NULL ids are rows like others and each counts; an empty
table gives no rows; only id and text are read, so other columns cannot clash. Very long
texts make a block of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.llm.byte_bpe import ByteBpe
from meterlake.llm.common import stored

#: Characters of text encoded at once, and in one block.
BATCH_CHARS, BLOCK_CHARS = 500_000, 6_000_000

_NO_IDS = np.empty(0, np.int64)


def gallop(needles: np.ndarray, values: np.ndarray, low: np.ndarray, high: np.ndarray, guess: np.ndarray) -> np.ndarray:
    """For every needle the first index in [low, high) of the sorted ``values`` that holds no
    smaller value (``high`` if none): exponential steps away from the guess, then bisection."""
    at = np.clip(guess, low, np.maximum(high - 1, low))
    n = len(values)
    get = lambda i: values[np.minimum(i, n - 1)]
    below = (at < high) & (get(at) < needles)
    # bracket: everything before lo is smaller, hi (or the end) is not
    lo, hi = np.where(below, at + 1, low), np.where(below, high, np.minimum(at, high))
    live, step = np.flatnonzero(lo < hi), 1
    while len(live):
        up = below[live]
        probe = np.where(up, np.minimum(at[live] + step, high[live] - 1), np.maximum(at[live] - step, low[live]))
        smaller = values[probe] < needles[live]
        lo[live] = np.where(smaller, np.maximum(lo[live], probe + 1), lo[live])
        hi[live] = np.where(smaller, hi[live], np.minimum(hi[live], probe))
        # a step that crossed the needle, or the end of the list, ends the exponential phase
        more = (up == smaller) & np.where(up, probe < high[live] - 1, probe > low[live])
        live, step = live[more & (lo[live] < hi[live])], step * 2
    live = np.flatnonzero(lo < hi)
    while len(live):
        mid = (lo[live] + hi[live]) >> 1
        smaller = values[mid] < needles[live]
        lo[live] = np.where(smaller, mid + 1, lo[live])
        hi[live] = np.where(smaller, hi[live], mid)
        live = live[lo[live] < hi[live]]
    return lo


def search_lists(short: np.ndarray, s_off: np.ndarray, long: np.ndarray, l_off: np.ndarray) -> np.ndarray:
    """Ranks of the ends in ``short`` within the list of their own document in ``long``; the lists
    lie one after another, cut by offsets. The guess is the place in proportion to both lengths."""
    ns, nl = np.diff(s_off), np.diff(l_off)
    doc = np.repeat(np.arange(len(ns)), ns)
    place = np.arange(len(short)) - s_off[doc]
    return gallop(short, long, l_off[doc], l_off[doc + 1], l_off[doc] + place * nl[doc] // np.maximum(ns[doc], 1))


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... (count[i] of them) for every i, one after another."""
    ends = np.cumsum(count)
    return np.repeat(first - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)


class Aligned:
    """Groups and links of a batch of documents given as token ends (A and B, with offsets)."""

    def __init__(self, a_ends, a_off, b_ends, b_off):
        na, nb = np.diff(a_off), np.diff(b_off)
        n = len(na)
        common = [np.zeros(len(a_ends), bool), np.zeros(len(b_ends), bool)]
        first, count = [], []
        for a_drives in (True, False):  # documents whose A list is the shorter one, then the others
            mine = (na <= nb) if a_drives else (na > nb)
            ends, off, other, o_off = (a_ends, a_off, b_ends, b_off) if a_drives else (b_ends, b_off, a_ends, a_off)
            sizes = np.where(mine, np.diff(off), 0)
            rows = _ranges(off[:-1], sizes)
            s_off = np.concatenate([[0], np.cumsum(sizes)])
            o_sizes = np.where(mine, np.diff(o_off), 0)
            o_rows = _ranges(o_off[:-1], o_sizes)
            l_off = np.concatenate([[0], np.cumsum(o_sizes)])
            short, long = ends[rows], other[o_rows]
            rank = search_lists(short, s_off, long, l_off) if len(short) else _NO_IDS
            hit = long[np.minimum(rank, max(len(long) - 1, 0))] == short if len(short) else np.empty(0, bool)
            common[0 if a_drives else 1][rows[hit]] = True
            common[1 if a_drives else 0][o_rows[rank[hit]]] = True
            # a token overlaps the other list from the rank of its start to the rank of its end
            start = np.empty(len(rank), np.int64)
            start[1:] = rank[:-1] + hit[:-1]
            opens = s_off[:-1][sizes > 0]
            start[opens] = l_off[:-1][sizes > 0]
            per = rank - start + 1
            left, right = np.repeat(rows, per), o_rows[_ranges(start, per)] if len(rows) else _NO_IDS
            first.append(left if a_drives else right)
            count.append(right if a_drives else left)
        self.a_common, self.b_common = common
        #: places of the linked tokens in the concatenated lists
        self.link_a, self.link_b = np.concatenate(first).astype(np.int64), np.concatenate(count).astype(np.int64)
        self.link_doc = np.repeat(np.arange(n), na)[self.link_a] if len(self.link_a) else _NO_IDS


class Aligner:
    """Both tokenizers with the bytes of their tokens and the strings of their ids."""

    def __init__(self, byte_model: str, piece_model: str):
        import sentencepiece
        self.a = ByteBpe(byte_model, plain=True)
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_model)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(pieces)]
        self.a_len = np.array([len(x) for x in self.a.bytes], np.int64)
        self.b_len = np.array([len(x) for x in self.b_bytes], np.int64)
        #: id strings followed by , or | (A) and by , or ; (B)
        self.parts = [f"{i}{end}" for n, ends in ((len(self.a_len), ",|"), (len(self.b_len), ",;")) for end in ends for i in range(n)]

    def tokens(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids by A and B; both empty unless either side's bytes are space + text."""
        if text:
            whole = " " + text
            raw = whole.encode()
            a = self.a.encode(whole).astype(np.int64)
            if b"".join(map(self.a.bytes.__getitem__, a.tolist())) == raw:
                b = self.b.encode(text)
                if b"".join(map(self.b_bytes.__getitem__, b)) == raw:
                    return a, np.array(b, np.int64)
        return _NO_IDS, _NO_IDS

    def batch(self, texts: list[str | None]):
        """(ids A, offsets A, ids B, offsets B, alignment) of some documents."""
        pairs = [self.tokens(t) for t in texts]
        out = []
        for side in (0, 1):
            out += [np.concatenate([p[side] for p in pairs]) if pairs else _NO_IDS,
                    np.concatenate([[0], np.cumsum([len(p[side]) for p in pairs])]).astype(np.int64)]
        a, a_off, b, b_off = out
        ends = []
        for ids, off, sizes in ((a, a_off, self.a_len), (b, b_off, self.b_len)):
            total = np.concatenate([[0], np.cumsum(sizes[ids])])
            ends.append(total[1:] - np.repeat(total[off[:-1]], np.diff(off)))
        return a, a_off, b, b_off, Aligned(ends[0], a_off, ends[1], b_off)

    def group_strings(self, a, a_off, b, b_off, found: Aligned) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` of each document."""
        na, nb = len(self.a_len), len(self.b_len)
        group_a = np.cumsum(found.a_common) - found.a_common  # groups before a token's own
        group_b = np.cumsum(found.b_common) - found.b_common
        a_until = np.cumsum(np.bincount(group_a, minlength=int(found.a_common.sum())))
        b_until = np.concatenate([[0], np.cumsum(np.bincount(group_b, minlength=int(found.b_common.sum())))])
        code = np.empty(len(a) + len(b), np.int64)
        code[np.arange(len(a)) + b_until[group_a]] = a + np.where(found.a_common, na, 0)
        code[np.arange(len(b)) + a_until[group_b]] = b + 2 * na + np.where(found.b_common, nb, 0)
        words = list(map(self.parts.__getitem__, code.tolist()))
        off = (a_off + b_off).tolist()
        return ["".join(words[i:j])[:-1] for i, j in zip(off, off[1:])]


def groups_of(text: str | None, aligner: Aligner) -> list[tuple[list[int], list[int]]]:
    """The groups of one text as (ids of A, ids of B)."""
    line = aligner.group_strings(*aligner.batch([text]))[0]
    return [tuple([int(i) for i in side.split(",")] for side in group.split("|")) for group in line.split(";")] if line else []


def links_of(text: str | None, aligner: Aligner) -> list[tuple[int, int]]:
    """The links of one text as (place in A, place in B)."""
    found = aligner.batch([text])[4]
    return sorted(zip(found.link_a.tolist(), found.link_b.tolist(), strict=True))


_BLOCK = "block long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, " \
         "groups_sha256 array<string>, held array<long>, pairs long, packed binary, a array<int>, b array<int>, n array<long>"


def _blocks(byte_model: str, piece_model: str):
    """One row per block: its documents' figures, its distinct pairs with their counts, and, packed,
    the (pair's place, count) list of each document (``held`` pairs of each)."""
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(byte_model, piece_model)
        wide = len(aligner.b_len)
        number = [TaskContext.get().partitionId() << 32]  # the same when a task is repeated

        def figures(ids, texts):
            a, a_off, b, b_off, found = aligner.batch(texts)
            lines = aligner.group_strings(a, a_off, b, b_off, found)
            common = np.concatenate([[0], np.cumsum(found.a_common)])
            pair = a[found.link_a] * wide + b[found.link_b]
            names, place = np.unique(pair, return_inverse=True)
            own, times = np.unique(found.link_doc * max(len(names), 1) + place, return_counts=True)
            held = np.bincount(own // max(len(names), 1), minlength=len(ids))[:len(ids)]
            return {"doc_id": ids, "n_a": np.diff(a_off), "n_b": np.diff(b_off), "n_groups": np.diff(common[a_off]),
                    "n_links": np.bincount(found.link_doc, minlength=len(ids))[:len(ids)],
                    "sha": [hashlib.sha256(s.encode()).hexdigest() if s else "" for s in lines],
                    "held": held, "names": names, "place": own % max(len(names), 1), "times": times}

        def flush(parts):
            number[0] += 1
            names = np.unique(np.concatenate([p["names"] for p in parts]))
            place = np.concatenate([np.searchsorted(names, p["names"])[p["place"]] for p in parts]) if len(names) else _NO_IDS
            times = np.concatenate([p["times"] for p in parts])
            total = np.bincount(place, weights=times, minlength=len(names)).astype(np.int64)
            packed = zstandard.ZstdCompressor(level=3).compress(place.astype("<i4").tobytes() + times.astype("<i4").tobytes())
            row = [number[0], [i for p in parts for i in p["doc_id"]],
                   *(np.concatenate([p[c] for p in parts]) for c in ("n_a", "n_b", "n_groups", "n_links")),
                   [s for p in parts for s in p["sha"]], np.concatenate([p["held"] for p in parts]), len(names), packed,
                   (names // wide).astype(np.int32), (names % wide).astype(np.int32), total]
            longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
            kinds = [pa.int64(), *[longs] * 5, pa.list_(pa.string()), longs, pa.int64(), pa.binary(), ints, ints, longs]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)],
                                              names=[c.split()[0] for c in _BLOCK.split(", ")])

        parts, ids, texts, chars, size = [], [], [], 0, 0
        for batch in batches:
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids.append(i)
                texts.append(text)
                chars += len(text or "")
                if chars >= BATCH_CHARS or len(ids) >= 10_000:
                    parts.append(figures(ids, texts))
                    size += chars
                    ids, texts, chars = [], [], 0
                    if size >= BLOCK_CHARS:
                        yield flush(parts)
                        parts, size = [], 0
        if ids:
            parts.append(figures(ids, texts))
        if parts:
            yield flush(parts)
    return blocks


_FIGURES = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def _finish(block: pa.Table, sums: pa.Table) -> pa.Table:
    """Figures of one block's documents with the corpus-wide counts of their pairs."""
    one = {c: block.column(c).combine_chunks() for c in block.column_names}
    count, best = np.zeros(one["pairs"][0].as_py(), np.int64), np.zeros(one["pairs"][0].as_py(), bool)
    at = sums.column("at").to_numpy()
    count[at], best[at] = sums.column("total").to_numpy(), sums.column("best").to_numpy()
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(one["packed"][0].as_py()), "<i4").astype(np.int64)
    place, times = flat[:len(flat) // 2], flat[len(flat) // 2:]
    ends = np.concatenate([[0], np.cumsum(one["held"][0].values.to_numpy())])
    add = lambda x: pa.array(np.diff(np.concatenate([[0], np.cumsum(x)])[ends]).astype(np.int64))
    mine = {"n_best": add(times * best[place]), "count_sum": add(times * count[place])}
    return pa.table([mine[c] if c in mine else one[c][0].values for c in _FIGURES], names=list(_FIGURES))


def align(docs: DataFrame, byte_model: str, piece_model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: one row per document."""
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    blocks = stored(read.mapInArrow(_blocks(byte_model, piece_model), _BLOCK), "alignment")
    pairs = blocks.select("block", F.posexplode(F.arrays_zip("a", "b", "n")).alias("at", "p")).select("block", "at", "p.a", "p.b", "p.n")
    # one exchange by pair serves the sums and the way back to the blocks; a block names a pair once
    dealt = pairs.repartition("a", "b")
    sums = dealt.groupBy("a", "b").agg(F.sum("n").alias("total"))
    most = sums.groupBy("b").agg(F.max("total").alias("most"))
    named = sums.join(most, "b").select("a", "b", "total", (F.col("total") == F.col("most")).alias("best"))
    back = dealt.select("block", "at", "a", "b").join(named, ["a", "b"]).select("block", "at", "total", "best")
    packed = blocks.select(F.col("block").alias("own"), *[c for c in blocks.columns if c not in ("block", "a", "b", "n")])
    return packed.groupBy("own").cogroup(back.groupBy("block")).applyInArrow(
        _finish, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
