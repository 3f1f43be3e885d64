"""Phrase mining against a brute-force count of every n-gram, and the index against plain search."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from meterlake.llm import collocations
from meterlake.llm.common import table


def brute(docs, min_count, top=2000, covered=80):
    counts, n = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                counts[lang].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        rows = []
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= min_count}
        parts = defaultdict(int)
        for p, a in cand.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    parts[p[i:i + size]] = max(parts[p[i:i + size]], a)
        for p, a in cand.items():
            if 100 * parts[p] >= covered * a:
                continue
            score, _, left, right = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def hand_docs():
    rng = np.random.default_rng(2)
    words = ["New", "York", "city", "the", "of", "ß", "Éa", "é", "東京", "a|b", "x y"]
    docs = [("en", " ".join(rng.choice(words, 60)) + ". " + "la la la la la, " * 2 + "New York city hall!") for _ in range(40)]
    docs += [(None, "ping pong\tping pong\nping pong"), (None, "ping pong ping"), ("de", None), ("de", ""), ("fr", "., ;"), ("en", "alone")] * 4
    return docs


def result(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("chars, top", [(collocations.SHARD_CHARS, 2000), (700, 2000), (700, 7)])
def test_hand_made_texts(spark, monkeypatch, chars, top):
    """One shard a language and many; phrases, ties at the limit, repeated words."""
    monkeypatch.setattr(collocations, "SHARD_CHARS", chars)
    docs = hand_docs()
    df = spark.createDataFrame([(lang, text, 1) for lang, text in docs], "lang string, text string, shard int").repartition(3)
    assert result(collocations.collocations(df, min_count=5, top=top)) == brute(docs, 5, top)


def test_given_documents(spark):
    df = table(spark, "/root/testdata/sf0.001", "documents")
    docs = [(r.lang, r.text) for r in df.select("lang", "text").collect()]
    assert result(collocations.collocations(df, min_count=6)) == brute(docs, 6)


def test_index_intervals():
    rng = np.random.default_rng(8)
    text = collocations._joined_ends(rng.integers(0, 6, 500))
    index = collocations.PhraseIndex(text, 6)
    grams = lambda k: Counter(t for t in zip(*(text[i:len(text) - k + 1 + i].tolist() for i in range(k))) if 0 not in t)
    assert {(a, b): n for a, b, n in zip(index.left.tolist(), index.right.tolist(), index.size.tolist())} == grams(2)
    *words, n = index.longer(np.ones(len(index.key), bool))
    got = {tuple(x for x in gram if x): k for *gram, k in zip(*(w.tolist() for w in words), n.tolist())}
    assert got == grams(3) + grams(4)


def test_long_texts_are_cut_at_piece_ends(monkeypatch):
    monkeypatch.setattr(collocations, "SHARD_CHARS", 20)
    text = "a b c d e f g h i, j k l m n o p q r s t u v w. x" + " y" * 30
    parts = list(collocations._parts(text))
    assert "".join(parts) == text and len(parts) == 3 and parts[0].endswith(",") and parts[1].endswith(".")


def test_scores_past_64_bits(spark):
    big = 9 * 10 ** 15
    df = spark.createDataFrame([(big, [big, big + 7], [big + 1, big])], "a long, heads array<long>, tails array<long>")
    c = df.select(collocations._weakest_cut().alias("c")).first().c
    assert 2_000_000 * big // (2 * big + 1) == 2_000_000 * big // (2 * big + 7) == 999_999  # a tie: the shorter first part
    assert tuple(c) == (999_999, 0, big, big + 1)


def test_empty_table(spark):
    assert collocations.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0


def test_runs_round_trip_and_sum():
    """Runs of two shards: unpacked as dealt, summed, and answered phrase by phrase in the shard's own order."""
    rng = np.random.default_rng(4)
    shards = []
    for _ in range(2):
        pairs = np.array(sorted({(int(a), int(b)) for a, b in rng.integers(-1, 40, (300, 2))}), np.int64) * (1 << 40)
        shards.append((pairs[rng.permutation(len(pairs))].T, rng.integers(1, 30, len(pairs))))
    whole = Counter()
    for words, counts in shards:
        whole.update({tuple(p): n for p, n in zip(words.T.tolist(), counts.tolist())})
    rows = [(k, name, run) for k, (words, counts) in enumerate(shards)
            for name, run in zip(*collocations._runs(list(words), counts, 5))]
    found, answers = {}, {}
    for name in range(5):
        mine = [r for r in rows if r[1] == name]
        table_ = collocations.pa.table({"shard": [r[0] for r in mine], "bucket": [r[1] for r in mine], "packed": [r[2] for r in mine]})
        for r in collocations._summed(table_, 2, 30).to_pylist():
            if r["shard"] is None:
                found[r["x"], r["y"]] = r["a"]
            else:
                answers[r["shard"], r["bucket"]] = r["bits"]
    assert found == {p: n for p, n in whole.items() if n >= 30} and 0 < len(found) < len(whole)
    for k, (words, _) in enumerate(shards):
        order, names, edges = collocations._dealt(list(words), 5)
        for name, start, end in zip(names, edges[:-1], edges[1:]):
            bits = np.unpackbits(np.frombuffer(answers[k, name], np.uint8), count=end - start)
            assert bits.tolist() == [whole[tuple(p)] >= 30 for p in words[:, order[start:end]].T.tolist()]


def test_many_buckets(spark, monkeypatch):
    """More buckets than phrases of a shard: some runs are missing, nothing is lost."""
    monkeypatch.setattr(collocations, "SHARD_CHARS", 700)
    monkeypatch.setattr(collocations, "BUCKET_WORDS", 40)
    docs = hand_docs()
    df = spark.createDataFrame(docs, "lang string, text string").repartition(3)
    assert result(collocations.collocations(df, min_count=5)) == brute(docs, 5)
