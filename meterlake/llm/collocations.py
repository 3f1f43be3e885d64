"""Phrase collocation mining on an FM-index per shard over word ids.

1. A task gathers the words of its documents, language by language, into shards of bounded
   size. Word counts are summed over the shards; a shard gets back the ids of its own words
   that are frequent in the corpus (a phrase cannot be more frequent than its words) and
   builds a bidirectional FM-index over them: the Burrows-Wheeler transforms of the text and
   of its reverse, sorted to the depth of the longest phrase, with the piece ends as symbol 0.
2. Extending the interval of every word to the left enumerates the two-word phrases with
   their counts. They are summed over the shards, and each shard gets back the ids of its own
   frequent ones.
3. From these, intervals are extended to the left (three words) and then to the right (four
   words), as long as every two-word part is frequent. Counts are again summed over the shards.
   On the way there and back a word is one row per shard that holds it: one exchange by word,
   a window that sums it, and one exchange by shard. Phrases travel in runs: a shard deals its
   phrases to buckets by a hash of their word ids, and each bucket's share is one row that packs
   them in order; a bucket sums its runs and answers each with one bit per phrase.
4. The tables of frequent phrases carry the counts of all their first and last parts, so cuts,
   scores and containment need joins of phrases with their one-word-shorter parts only.

Counts are exact; nothing but a shard (bounded by ``SHARD_CHARS``, or one piece) is ever
held by a task besides a bucket (about ``BUCKET_WORDS`` phrases), and every shard names a phrase
once, so a very common phrase is one row, or one entry of a run, a shard.

Defined results: NULL texts are empty; a NULL language is ``und``; repeated rows count again;
an empty table, or one without frequent phrases, gives no rows; only language and text are
read, so other columns cannot clash; very long texts are cut at piece ends into several shards.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlake.llm.common import cut, mix64, stored

#: Characters of text that a task gathers before its largest shard is closed.
SHARD_CHARS = 12_000_000
#: Words of the corpus for each bucket of phrases; a bucket holds at most about as many phrases of one length.
BUCKET_WORDS = 1_000_000
#: Words of the longest phrase: the depth to which the index is sorted.
DEPTH = 4
#: Least count of a phrase; share (in percent) of its count from which a longer one replaces it.
MIN_COUNT, COVERED = 30, 80

#: Bits of a place (shard and number of a word or pair in it) that are the number.
_PLACE_BITS = 24

_ENDS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", b"\n" * 10 + b" ")
_PIECE_END = re.compile("[.,;:!?\n\x0b\x0c\r]")


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... (count[i] of them) for every i, one after another."""
    ends = np.cumsum(count)
    return np.repeat(first - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)


class FmIndex:
    """Burrows-Wheeler transform of a cyclic text of symbols, its suffixes sorted by ``DEPTH`` symbols."""

    def __init__(self, text: np.ndarray, symbols: int):
        rank, span = text.astype(np.int64), 1
        while span < DEPTH:
            rank = np.unique(rank * (rank.max() + 1) + np.roll(rank, -span), return_inverse=True)[1]
            span *= 2
        order = np.argsort(rank, kind="stable")
        self.symbols, self.bwt = symbols, text[order - 1].astype(np.int64)
        #: rows whose suffix starts with a smaller symbol
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])
        self.lf = np.empty(len(text), np.int64)
        self.lf[np.argsort(self.bwt, kind="stable")] = np.arange(len(text))

    def extend(self, low: np.ndarray, size: np.ndarray, other: np.ndarray):
        """All extensions of the intervals [low, low + size) by the symbol before them: (interval,
        symbol, new low, new size, new low in the other direction's index), sorted by interval and symbol."""
        rows, owner = _ranges(low, size), np.repeat(np.arange(len(low)), size)
        key = owner * self.symbols + self.bwt[rows]
        order = np.argsort(key, kind="stable")
        starts = np.flatnonzero(np.diff(key[order], prepend=-1))
        owner, symbol = np.divmod(key[order[starts]], self.symbols)
        count = np.diff(starts, append=len(order))
        # the smaller symbols of the same interval come first in the other index
        before = starts - (np.cumsum(size) - size)[owner]
        word = symbol > 0
        return (owner[word], symbol[word], self.lf[rows[order[starts]]][word], count[word], (other[owner] + before)[word])


class PhraseIndex:
    """Both directions of a shard, and its two-word phrases in the order of (second, first) word."""

    def __init__(self, text: np.ndarray, symbols: int):
        self.forward, self.reverse = FmIndex(text, symbols), FmIndex(text[::-1], symbols)
        words = np.arange(1, symbols)
        low = self.forward.first[words]
        second, self.left, self.low, self.size, self.back = self.forward.extend(low, self.forward.first[words + 1] - low, low)
        self.right, self.symbols = second + 1, symbols
        self.key = self.right * symbols + self.left

    def known(self, left: np.ndarray, right: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Whether two-word phrases are among the wanted ones."""
        key = right * self.symbols + left
        at = np.minimum(np.searchsorted(self.key, key), max(len(self.key) - 1, 0))
        return (self.key[at] == key) & wanted[at] if len(self.key) else np.zeros(len(key), bool)

    def longer(self, wanted: np.ndarray):
        """(four word symbols, the last 0 for phrases of three words; count) of the phrases of
        three and four words whose two-word parts are all wanted."""
        live = np.flatnonzero(wanted)
        owner, first, low, size, back = self.forward.extend(self.low[live], self.size[live], self.back[live])
        owner = live[owner]
        ok = self.known(first, self.left[owner], wanted)
        owner, first, low, size, back = owner[ok], first[ok], low[ok], size[ok], back[ok]
        second, third = self.left[owner], self.right[owner]
        three, fourth, _, count, _ = self.reverse.extend(back, size, low)
        ok = self.known(third[three], fourth, wanted)
        three, fourth, count = three[ok], fourth[ok], count[ok]
        words = [np.concatenate([x, x[three]]) for x in (first, second, third)]
        return (*words, np.concatenate([np.zeros(len(first), np.int64), fourth]), np.concatenate([size, count]))


def _pack(symbols: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(symbols.astype("<i4").tobytes())


def _unpack(packed: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), "<i4")


def _dealt(words: list[np.ndarray], buckets: int):
    """(order, buckets, edges): the phrases (word ids by place) ordered by bucket, then by ids, the
    buckets that have any, and where they start and end in that order. The same phrases give the same answer."""
    key = np.full(len(words[0]), len(words), np.uint64)
    for ids in words:
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + ids.astype(np.uint64))
    bucket = (key % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort([*words[::-1], bucket])
    starts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    return order, bucket[order[starts]], np.append(starts, len(order))


def _runs(words: list[np.ndarray], counts: np.ndarray, buckets: int) -> tuple[np.ndarray, list[bytes]]:
    """The buckets that get some of the phrases, and the packed run for each: the bytes of equal weight
    of a column lie together, and the first ids, which ascend, are differences."""
    order, names, edges = _dealt(words, buckets)
    columns, zstd = np.stack([*words, counts]).astype("<i8")[:, order], zstandard.ZstdCompressor(level=3)
    out = []
    for start, end in zip(edges[:-1], edges[1:], strict=True):
        run = columns[:, start:end].copy()
        run[0, 1:] -= run[0, :-1].copy()
        out.append(zstd.compress(np.ascontiguousarray(run.view(np.uint8).reshape(len(run), -1, 8).transpose(0, 2, 1)).tobytes()))
    return names, out


def _run(packed: bytes, columns: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(columns, 8, -1)
    run = planes.transpose(0, 2, 1).copy().view("<i8")[:, :, 0]
    run[0] = np.cumsum(run[0])
    return run


def _summed(runs: pa.Table, size: int, min_count: int) -> pa.Table:
    """A bucket's phrases of ``size`` ids that are frequent, with their counts; then, for runs that
    name their shard, one bit per phrase of each run: whether it is frequent."""
    parts = [_run(packed, size + 1) for packed in runs.column("packed").to_pylist()]
    lengths = [p.shape[1] for p in parts]
    rows = np.concatenate(parts, axis=1)
    del parts
    order = np.lexsort(rows[:size][::-1])
    rows = rows[:, order]
    new = np.ones(rows.shape[1], bool)
    new[1:] = (rows[:size, 1:] != rows[:size, :-1]).any(axis=0)
    starts = np.flatnonzero(new)
    total = np.add.reduceat(rows[size], starts)
    frequent = total >= min_count
    found = rows[:size, starts[frequent]]
    out = {**{k: pa.array(c) for k, c in zip(_IDS[:size], found, strict=True)}, "a": pa.array(total[frequent])}
    if "shard" not in runs.column_names:
        return pa.table(out)
    known = np.empty(len(order), bool)
    known[order] = np.repeat(frequent, np.diff(starts, append=len(order)))
    bits = [np.packbits(part).tobytes() for part in np.split(known, np.cumsum(lengths)[:-1])]
    answers = {"shard": runs.column("shard"), "bucket": runs.column("bucket"), "bits": pa.array(bits, pa.binary())}
    types = {**{k: pa.int64() for k in out}, "shard": pa.int64(), "bucket": pa.int64(), "bits": pa.binary()}
    both = [pa.table({k: t[k] if k in t else pa.nulls(n, types[k]) for k in types}).cast(pa.schema(types.items()))
            for t, n in ((out, int(frequent.sum())), (answers, len(bits)))]
    return pa.concat_tables(both)


def _joined_ends(text: np.ndarray) -> np.ndarray:
    """The text with one 0 for each run of piece ends, and one at its end."""
    text = np.append(text, 0)
    return text[(text > 0) | (np.roll(text, 1) != 0)] if (text > 0).any() else text[:1]


class _Words(dict):
    """Numbers of the words of a shard, from 1; 0 ends a piece, -1 is no word."""

    def __init__(self):
        super().__init__({b"\n": 0, b"": -1})

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self) - 1
        return n

    def numbers(self, text: str) -> np.ndarray:
        words = (text.encode().lower().translate(_ENDS).replace(b"\n", b" \n ") + b" \n").split(b" ")
        found = np.fromiter(map(self.__getitem__, words), np.int32, len(words))
        return found[found >= 0]


def _parts(text: str) -> Iterator[str]:
    """The text, cut after piece ends if it is longer than a shard."""
    at = 0
    while len(text) - at > SHARD_CHARS:
        end = _PIECE_END.search(text, at + SHARD_CHARS // 2)
        if not end:
            break
        yield text[at:end.end()]
        at = end.end()
    yield text[at:]


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per shard: its words with their counts, and its packed text."""
    number = TaskContext.get().partitionId() << 18  # the same when a task is repeated
    open_: dict[str, tuple[_Words, list, int]] = {}

    def close(lang):
        nonlocal number
        words, parts, _ = open_.pop(lang)
        number += 1
        text = _joined_ends(np.concatenate(parts))
        counts = np.bincount(text, minlength=len(words) - 1)[1:]
        return pa.RecordBatch.from_arrays(
            [pa.array([number]), pa.array([lang]), pa.array([list(words)[2:]], pa.list_(pa.binary())).cast(pa.list_(pa.string())),
             pa.array([counts], pa.list_(pa.int64())), pa.array([_pack(text)])], names=["shard", "lang", "words", "counts", "text"])

    total = 0
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            for part in _parts(text):
                words, parts, chars = open_.get(lang) or (_Words(), [], 0)
                parts.append(words.numbers(part))
                open_[lang] = (words, parts, chars + len(part))
                total += len(part)
                while total >= SHARD_CHARS and open_:
                    largest = max(open_, key=lambda x: open_[x][2])
                    total -= open_[largest][2]
                    yield close(largest)
    for lang in list(open_):
        yield close(lang)


def _pairs(shard: pa.Table, known: pa.Table, buckets: int) -> pa.Table:
    """The shard's text over its frequent words, and the runs of its two-word phrases."""
    at, ids = known.column("at").to_numpy(), known.column("id").to_numpy()
    text = _unpack(shard.column("text")[0].as_py())
    number = np.zeros(max(int(text.max()), int(at.max(initial=-1)) + 1) + 1, np.int64)
    number[at + 1] = np.arange(1, len(at) + 1)
    text = _joined_ends(number[text])
    index = PhraseIndex(text, len(at) + 1)
    names, runs = _runs([ids[index.left - 1], ids[index.right - 1]], index.size, buckets)
    return pa.table([shard.column("own"), pa.array([_pack(text)]), pa.array([ids], pa.list_(pa.int64())),
                     pa.array([names], pa.list_(pa.int64())), pa.array([runs], pa.list_(pa.binary()))],
                    names=["shard", "text", "ids", "buckets", "runs"])


def _longer(shard: pa.Table, known: pa.Table, buckets: int) -> pa.Table:
    """The runs of a shard's phrases of three and four words, by the ids of their words (-1: no fourth)."""
    ids = np.concatenate([[-1], shard.column("ids").combine_chunks()[0].values.to_numpy()])
    index = PhraseIndex(_unpack(shard.column("text")[0].as_py()), len(ids))
    order, names, edges = _dealt([ids[index.left], ids[index.right]], buckets)
    answers = dict(zip(known.column("bucket").to_pylist(), known.column("bits").to_pylist(), strict=True))
    wanted = np.zeros(len(order), bool)
    for name, start, end in zip(names.tolist(), edges[:-1], edges[1:], strict=True):
        wanted[order[start:end]] = np.unpackbits(np.frombuffer(answers[name], np.uint8), count=end - start)
    *words, count = index.longer(wanted)
    names, runs = _runs([ids[w] for w in words], count, buckets)
    return pa.table([pa.array(names, pa.int64()), pa.array(runs, pa.binary())], names=["bucket", "packed"])


def _by_shard(shards: DataFrame, known: DataFrame, parts: int, fn, schema: str) -> DataFrame:
    """``fn`` on every shard with the rows known of it (none for some)."""
    return shards.withColumnRenamed("shard", "own").repartition(parts, "own").groupBy("own") \
        .cogroup(known.repartition(parts, "shard").groupBy("shard")).applyInArrow(fn, schema)


def frequent_phrases(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", min_count: int = MIN_COUNT) -> tuple[DataFrame, DataFrame]:
    """(totals, phrases): words per language; and lang, phrase, words, a (count), heads and tails
    (counts of its first and last parts, by cut), longer (largest count of a phrase that holds it with one word more)."""
    read = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    shards = stored(read.mapInArrow(_shards, "shard long, lang string, words array<string>, counts array<long>, text binary"), "phrase-shards")
    size = shards.agg(F.count("*").alias("shards"), F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, n: a + n)).alias("words")).first()
    parts, buckets = min(-(-size.shards // 3) + 1, 20_000), (size.words or 0) // BUCKET_WORDS + 1
    named = shards.select("shard", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "w")) \
        .select("shard", "lang", "at", F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    totals = named.groupBy("lang").agg(F.sum("n").alias("n"))
    words = _frequent(named, ["lang", "word"], min_count, "phrase-words")
    one = words.where("place = id").select("id", "lang", F.col("word").alias("phrase"), "a")
    two = stored(_by_shard(shards.select("shard", "text"), words.select(*_where(), "id"), parts, lambda shard, known: _pairs(shard, known, buckets),
                           "shard long, text binary, ids array<long>, buckets array<long>, runs array<binary>"), "phrase-pairs")
    runs = two.select("shard", F.explode(F.arrays_zip("buckets", "runs")).alias("r")) \
        .select("shard", F.col("r.buckets").alias("bucket"), F.col("r.runs").alias("packed"))
    pairs = stored(_by_bucket(runs, buckets, lambda runs: _summed(runs, 2, min_count),
                              "x long, y long, a long, shard long, bucket long, bits binary"), "phrase-two")
    runs = _by_shard(two.select("shard", "text", "ids"), pairs.where("shard is not null").select("shard", "bucket", "bits"), parts,
                     lambda shard, known: _longer(shard, known, buckets), "bucket long, packed binary")
    more = cut(_by_bucket(runs, buckets, lambda runs: _summed(runs, 4, min_count), "x long, y long, z long, w long, a long"))
    return totals, _with_parts(one, pairs.where("shard is null").select("x", "y", "a"), more)


def _by_bucket(runs: DataFrame, buckets: int, fn, schema: str) -> DataFrame:
    return runs.repartition(min(buckets, 20_000), "bucket").groupBy("bucket").applyInArrow(fn, schema)


def _frequent(rows: DataFrame, keys: list[str], min_count: int, name: str) -> DataFrame:
    """place, id, a and the keys of the rows (shard, at, keys, n) whose phrase is frequent; ``id`` is
    the smallest place of the phrase, ``a`` its count, and only the row at that place has the keys."""
    place = (F.shiftleft("shard", _PLACE_BITS) + F.col("at")).alias("place")
    same = Window.partitionBy(*keys)
    summed = rows.select(place, *keys, "n").withColumns({"a": F.sum("n").over(same), "id": F.min("place").over(same)})
    first = [F.when(F.col("place") == F.col("id"), F.col(k)).alias(k) for k in keys]
    return stored(summed.where(F.col("a") >= min_count).select("place", "id", "a", *first), name)


def _where() -> list[Column]:
    """Shard and number of a place."""
    return [F.shiftright("place", _PLACE_BITS).alias("shard"), F.col("place").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)).cast("int").alias("at")]


_IDS = ["x", "y", "z", "w"]


def _grown(rows: DataFrame, parts: DataFrame, size: int) -> DataFrame:
    """Phrases of ``size`` words with what their parts without the last and without the first word know."""
    start, end = _IDS[:size - 1], _IDS[1:size]
    h = parts.select(*start, "lang", F.col("phrase").alias("_start"), F.col("heads").alias("_heads"), F.col("a").alias("_ha"))
    t = parts.select(*[F.col(k).alias(e) for k, e in zip(start, end, strict=True)], F.col("last").alias("_last"), F.col("tails").alias("_tails"),
                     F.col("a").alias("_ta"))
    return rows.join(h, start).join(t, end).select(
        *_IDS[:size], "a", "lang", F.concat_ws(" ", "_start", "_last").alias("phrase"), F.col("_last").alias("last"),
        F.concat("_heads", F.array("_ha")).alias("heads"), F.concat(F.array("_ta"), "_tails").alias("tails"))


def _with_parts(one: DataFrame, two: DataFrame, more: DataFrame) -> DataFrame:
    none = F.array().cast("array<long>")
    sized = [one.select(F.col("id").alias("x"), "lang", "phrase", F.col("phrase").alias("last"), "a", none.alias("heads"), none.alias("tails"))]
    for size, rows in ((2, two), (3, more.where("w = -1").drop("w")), (4, more.where("w <> -1"))):
        sized.append(cut(_grown(rows, sized[-1], size)))
    out = []
    for size, phrases in enumerate(sized[1:], 2):
        keys = _IDS[:size]
        longest = F.lit(None).cast("long").alias("longer")
        if size < DEPTH:
            at_ends = [sized[size].select(*[F.col(k).alias(n) for k, n in zip(side, keys, strict=True)], F.col("a").alias("longer"))
                       for side in (_IDS[:size], _IDS[1:size + 1])]
            phrases = phrases.join(at_ends[0].unionAll(at_ends[1]).groupBy(*keys).agg(F.max("longer").alias("longer")), keys, "left")
            longest = F.col("longer")
        out.append(phrases.select("lang", "phrase", "a", "heads", "tails", longest))
    return out[0].unionAll(out[1]).unionAll(out[2])


def _weakest_cut() -> Column:
    """The cut of the lowest score, the shortest first part on ties; decimals, as products may pass 64 bits."""
    d = lambda c: c.cast("decimal(20,0)")
    times = d(F.col("a")) * F.lit(Decimal(2_000_000))

    def score(l: Column, r: Column) -> Column:
        both = d(l) + d(r)
        return ((times - times % both) / both).cast("long")  # divides without a rest, so nothing is rounded
    return F.array_min(F.transform(F.arrays_zip("heads", "tails"), lambda p, k: F.struct(
        score(p["heads"], p["tails"]).alias("score"), k.alias("k"), p["heads"].alias("l"), p["tails"].alias("r"))))


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", min_count: int = MIN_COUNT,
                 covered: int = COVERED, top: int | None = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's phrases by score (``top`` of them, all for None)."""
    totals, phrases = frequent_phrases(docs, lang_col, text_col, min_count)
    whole = lambda c: F.col(c).cast("decimal(38,0)")
    kept = phrases.where(F.col("longer").isNull() | (whole("longer") * 100 < whole("a") * covered)) \
        .withColumn("c", _weakest_cut()).select("lang", "phrase", "a", "c.l", "c.r", "c.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order).cast("long"))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
