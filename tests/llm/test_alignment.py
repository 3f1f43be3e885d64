"""Token alignment against a brute-force reading of every pair of tokens."""

import hashlib
from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
import pytest

from meterlake.llm import alignment
from meterlake.llm.registry import byte_model, piece_model

TEXTS = ["the cat sat", "the cat sat", "Don't  stop — naïve 東京 🙂!", "a\n\nb\tc  ", " lead", "x" * 300, "▁odd", "", None, "<|endoftext|> <s> 12 345",
         "\u0000nul", "é ﬁ ①", *(f"word{i} of text number {i * 37}, the end." for i in range(60)), "tail " * 4000]


@pytest.fixture(scope="module")
def aligner():
    return alignment.Aligner(byte_model(), piece_model())


def brute(texts):
    """Per text: (n_a, n_b, groups line, links by ids), reading token byte ranges pair by pair."""
    import json

    import sentencepiece
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(byte_model())
    library.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    with open(byte_model(), encoding="utf-8") as f:
        names = {i: w for w, i in json.load(f)["model"]["vocab"].items()}
    shown = list(range(33, 127)) + list(range(161, 173)) + list(range(174, 256))
    char = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in shown)}
    out = []
    for t in texts:
        a = library.encode(" " + t, add_special_tokens=False).ids if t else []
        b = pieces.encode(t) if t else []
        raw_a = [bytes(char[c] for c in names[i]) for i in a]
        raw_b = []
        for i in b:
            p = pieces.id_to_piece(i)
            raw_b.append(bytes([int(p[3:5], 16)]) if pieces.is_byte(i) else p.replace("▁", " ").encode())
        if not t or b"".join(raw_a) != (" " + t).encode() or b"".join(raw_b) != (" " + t).encode():
            out.append((0, 0, "", []))
            continue
        span = lambda raw: (np.cumsum([0] + [len(x) for x in raw])[:-1].tolist(), np.cumsum([len(x) for x in raw]).tolist())
        (sa, ea), (sb, eb) = span(raw_a), span(raw_b)
        both = sorted(set(ea) & set(eb))
        line = ";".join(",".join(str(i) for i, e in zip(a, ea) if lo < e <= hi) + "|" + ",".join(str(i) for i, e in zip(b, eb) if lo < e <= hi)
                        for lo, hi in zip([0, *both], both))
        links = [(x, y) for i, x in enumerate(a) for j, y in enumerate(b) if sa[i] < eb[j] and sb[j] < ea[i]] if len(a) < 2000 else \
            [(x, y) for i, x in enumerate(a) for j, y in list(enumerate(b))[max(0, bisect_left(eb, sa[i]) - 1):bisect_left(sb, ea[i]) + 1]
             if sa[i] < eb[j] and sb[j] < ea[i]]
        out.append((len(a), len(b), line, links))
    return out


@pytest.mark.parametrize("batch, block", [(alignment.BATCH_CHARS, alignment.BLOCK_CHARS), (40, 200)])
def test_alignment_matches_brute_force(spark, monkeypatch, batch, block):
    monkeypatch.setattr(alignment, "BATCH_CHARS", batch)
    monkeypatch.setattr(alignment, "BLOCK_CHARS", block)
    big = 2 ** 60 + 1
    docs = spark.createDataFrame([(big + i, t, 1, "q") for i, t in enumerate(TEXTS)] + [(None, "the cat", 1, "q")],
                                 "doc_id long, text string, block int, a string").repartition(3)
    want = brute([*TEXTS, "the cat"])
    count = Counter(x for w in want for x in w[3])
    top = defaultdict(int)
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    got = {r.doc_id: r for r in alignment.align(docs, byte_model(), piece_model()).collect()}
    assert len(got) == len(want)
    for key, (na, nb, line, links) in zip([*(big + i for i in range(len(TEXTS))), None], want):
        r = got[key]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links) == (na, nb, line.count(";") + 1 if line else 0, len(links)), key
        assert r.groups_sha256 == (hashlib.sha256(line.encode()).hexdigest() if line else "")
        assert r.n_best == sum(count[x] == top[x[1]] for x in links) and r.count_sum == sum(count[x] for x in links)


def test_groups_and_links_of_one_text(aligner):
    line = brute(["Don't  stop"])[0][2]
    groups = alignment.groups_of("Don't  stop", aligner)
    assert ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups) == line
    assert alignment.links_of("the cat", aligner)[0] == (0, 0) and alignment.links_of(None, aligner) == [] == alignment.groups_of("", aligner)


def test_gallop_is_a_lower_bound():
    rng = np.random.default_rng(3)
    for _ in range(300):
        values = np.sort(rng.integers(0, 50, rng.integers(1, 40)))
        low = rng.integers(0, len(values), 20)
        high = rng.integers(low, len(values) + 1)
        needles, guess = rng.integers(-2, 53, 20), rng.integers(0, len(values), 20)
        want = [lo + np.searchsorted(values[lo:hi], x) for lo, hi, x in zip(low, high, needles)]
        assert alignment.gallop(needles, values, low, high, guess).tolist() == want


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align(docs, byte_model(), piece_model()).count() == 0
