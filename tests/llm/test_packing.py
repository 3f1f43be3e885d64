"""Packing: against the tokenizer library, by the rules of a packing, and against the least possible number of sequences."""

import zlib

import numpy as np
import pytest

from meterlake.llm import packing
from meterlake.llm.byte_bpe import ByteBpe
from meterlake.llm.registry import byte_model

WORDS = "alpha beta gamma delta straße naïve 東京 🙂 42 don't <|endoftext|> x y \n \t  ."


def texts():
    rng = np.random.default_rng(5)
    words = WORDS.split(" ")
    out = [" ".join(rng.choice(words, n)) for n in rng.integers(1, 3000, 60)]
    return [*out, None, "", "alpha", "alpha", " ".join(words * 900), *(["same text again"] * 300)]


@pytest.fixture(scope="module")
def packed(spark):
    docs = spark.createDataFrame([(i, t, "x", 7) for i, t in enumerate(texts())] + [(None, "no id", "x", 7), (3, "beta", None, 7)],
                                 "doc_id long, text string, length string, sequence_id int")
    return docs, packing.pack_documents(docs, byte_model()).toPandas()


def brute_pieces(docs):
    from tokenizers import Tokenizer
    library, out = Tokenizer.from_file(byte_model()), []
    for r in docs.collect():
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        cuts = [0, *range((len(ids) - 1) % 2048 + 1, len(ids) + 1, 2048)]
        out += [(r.doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    return out


def test_pieces_match_the_library(packed):
    docs, got = packed
    key = lambda x: tuple(-1 if v is None else v for v in x)
    mine = [(None if x != x or x is None else int(x), *map(int, rest)) for x, *rest in
            got[["doc_id", "piece", "start", "length", "ids_crc32"]].astype(object).where(got.notna(), None).itertuples(index=False)]
    assert sorted(mine, key=key) == sorted(brute_pieces(docs), key=key)


def test_sequences_are_gapless_and_few(packed):
    _, got = packed
    for _, one in got.groupby("sequence_id"):
        one = one.sort_values("offset")
        assert list(one["offset"]) == [0, *np.cumsum(one["length"])[:-1]] and one["length"].sum() <= 2048
    least = -(-int(got["length"].sum()) // 2048)
    assert got["sequence_id"].nunique() <= least * 1.05 + 1


@pytest.mark.parametrize("hot, n", [(False, 1), (False, 40), (False, 20_000), (True, 20_000)])
def test_plan_places_every_rank_once(hot, n):
    """The plan's intervals against a sequence-by-sequence reading of them."""
    rng = np.random.default_rng(n)
    lengths = rng.integers(1, 257, n)
    if hot:
        lengths[:n // 3] = 77
    counts = np.bincount(lengths, minlength=257)
    plan = packing.plan_packing(counts, 256, groups=40)
    rows = np.array(sorted(plan.rows))
    used, taken = np.zeros(plan.sequences, int), {}
    for length in np.flatnonzero(counts):
        own = rows[rows[:, 0] == length]
        assert own[0, 1] == 0 and len(set(own[:, 1])) == len(own)
        for (_, r0, seq, each, offset), r1 in zip(own, [*own[1:, 1], counts[length]]):
            for i in range(r1 - r0):
                taken.setdefault(seq + i // each, []).append((offset + i % each * length, length))
                used[seq + i // each] += length
    assert used.max() <= 256 and used.min() > 0 and used.sum() == (np.arange(257) * counts).sum()
    for parts in taken.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
    if n > 1000 and not hot:
        assert plan.sequences <= 1.03 * used.sum() / 256


def test_configurations_use_no_piece_twice():
    sizes, demand = np.array([200, 130, 90, 60]), np.array([7.0, 900.0, 41.0, 3.0])
    found = packing.configurations(sizes, demand, 256)
    assert all((a * sizes).sum() <= 256 for a, _ in found)
    assert (sum(a * n for a, n in found) <= demand).all()


def test_empty_table(spark, packed):
    docs, _ = packed
    assert packing.pack_documents(docs.limit(0), byte_model()).count() == 0


def test_fast_ids_equal_the_library_on_all_characters():
    """Every code point in a word, doubled, between blanks and digits."""
    bpe = ByteBpe(byte_model(), plain=True)
    chars = [chr(c) for c in [*range(1, 0x3000), *range(0x3000, 0x11_0000, 17)] if not 0xD800 <= c < 0xE000]
    batch = [" ".join(f"a{c}b {c}{c} 1{c}" for c in chars[i:i + 50]) for i in range(0, len(chars), 50)]
    slow = bpe.library.encode_batch(batch, add_special_tokens=False)
    assert [bpe.encode(t).tolist() for t in batch] == [e.ids for e in slow]
    assert bpe.encode("a<|endoftext|>b").tolist() == bpe.library.encode("a<|endoftext|>b", add_special_tokens=False).ids
