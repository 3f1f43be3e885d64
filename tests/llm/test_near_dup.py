"""Near-dedup: blocks of a bucket, and ids that stand for several texts."""

import random

import pytest

from meterlake.llm import near_dup
from meterlake.llm.common import unused


def family(base, n, rnd, share=0.9):
    """n texts that keep most words of one another."""
    return [" ".join(w if rnd.random() < share else f"v{rnd.randrange(10 ** 6)}" for w in base) for _ in range(n)]


def brute(texts, k, threshold=80):
    sets = {i: frozenset(tuple(w[j:j + k]) for j in range(max(1, len(w) - k + 1))) for i, w in ((i, t.split()) for i, t in texts)}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in sets}


@pytest.mark.parametrize("block", [5, near_dup.PAIR_BLOCK])
def test_blocks_lose_no_link(spark, monkeypatch, block):
    """One long shared passage puts unlike and alike texts into the same buckets."""
    monkeypatch.setattr(near_dup, "PAIR_BLOCK", block)
    rnd = random.Random(4)
    passage = [f"p{i}" for i in range(150)]
    texts = []
    for group in range(12):
        base = [f"g{group}x{i}" for i in range(90)]
        texts += [" ".join(passage) + " " + t for t in family(base, 5, rnd, 0.985)]
    texts += family(passage + [f"q{i}" for i in range(30)], 25, rnd, 0.99)
    rnd.shuffle(texts)
    rows = list(enumerate(texts))
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=4).collect()
    assert {r.doc_id: r.component_id for r in got} == brute(rows, 4)


def test_unlike_texts_of_one_id_stay(spark):
    """A copy under a repeated id goes, the other text of that id stays."""
    w, z = " ".join(f"w{i}" for i in range(60)), " ".join(f"z{i}" for i in range(60))
    rows = [(1, w, 1, 2), (5, w, 3, 4), (5, z, 5, 6), (7, z + " more", 7, 8), (9, None, 9, 1), (9, w, 1, 1), (9, "", 1, 3), (11, z, 1, 5), (11, z, 1, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id int, own int")
    left = near_dup.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted((r.doc_id, r.text or "") for r in left.collect()) == [(1, w), (5, z), (9, ""), (9, "")]


def test_unused_names():
    class Frame:
        columns = ["ID", "id_"]
    assert unused(Frame, "id") == "id__"
