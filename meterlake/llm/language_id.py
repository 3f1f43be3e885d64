"""Language identification by word-first backoff.

A known word adds its per-language log frequency. An unseen word is covered from left to
right by the longest known character n-gram (4, then 3, 2, 1 letters, with word-boundary
marks), each adding its per-language log frequency. The language with the largest sum
wins; ``score`` is its posterior probability under equal priors and a per-word mean that
keeps long texts from saturating.

The classifier is fitted on a bounded sample of the labelled rows: ``sample_rows`` ids, dealt
over the languages so that a rare one keeps all its rows and the others share the rest evenly
(the ids with the smallest hashes of each), at most ``max_words`` words and ``max_grams``
n-grams of each length per language, and the ``max_langs`` most frequent languages. The model is
therefore small whatever the corpus, and is broadcast; counting runs on the executors with
map-side totals. Prediction reads whole texts and nothing else. Frequencies are smoothed by one
count per item of the kind, and only languages with counts are predicted.

Defined results: NULL texts, texts without a letter and an empty training set give ``und``
with score 0; ties go to the first language in alphabetical order; rows with a NULL id or
language are predicted but never learned from; repeated rows get equal results; the report
reads id, language and text only, so other columns may have any names; texts are read whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterlake.llm.common import id_bucket

ORDERS = (4, 3, 2, 1)
SAMPLE_ROWS, MAX_WORDS, MAX_GRAMS, MAX_LANGS = 20_000, 20_000, 10_000, 100
#: Words whose sums a task may remember before it starts anew.
MEMO_LIMIT = 300_000
#: Words that count as evidence for the posterior at most.
EVIDENCE = 20.0

WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def cover(word: str, known: dict[str, int]) -> list[int]:
    """Left-to-right cover of ``^word$`` by the longest known n-grams."""
    s, out, i = f"^{word}$", [], 0
    while i < len(s):
        for n in ORDERS:
            g = known.get(s[i:i + n]) if i + n <= len(s) else None
            if g is not None:
                out.append(g)
                i += n
                break
        else:
            i += 1
    return out


def _count_udf(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(lang, text) rows to partial (lang, kind, item, n); kind 0 is a word, else an n-gram length."""
    for batch in rows:
        total: Counter = Counter()
        for lang, text in zip(batch["lang"], batch["text"], strict=True):
            for w, n in Counter(words_of(text)).items():
                total[lang, 0, w] += n
        for (lang, _, w), n in list(total.items()):
            s = f"^{w}$"
            for k in ORDERS:
                for i in range(len(s) - k + 1):
                    total[lang, k, s[i:i + k]] += n
        yield pd.DataFrame([(*key, n) for key, n in total.items()], columns=["lang", "kind", "item", "n"])


def quotas(counts: dict[str, int], size: int) -> dict[str, int]:
    """Rows of each language in a sample of ``size``: all of the rare ones, equal shares of the others."""
    out: dict[str, int] = {}
    for k, (lang, n) in enumerate(sorted(counts.items(), key=lambda x: (x[1], x[0]))):
        out[lang] = min(n, max(1, (size - sum(out.values())) // (len(counts) - k)))
    return out


def sample_by_language(named: DataFrame, counts: dict[str, int], size: int) -> DataFrame:
    """(lang, id) of a bounded sample: the smallest id hashes of each language.

    Rows that cannot be among them go before the exchange: twice the quota is expected to stay."""
    quota = quotas(counts, size)
    plan = named.sparkSession.createDataFrame(
        [(lang, q, min(1.0, (2 * q + 100) / counts[lang])) for lang, q in quota.items()], "lang string, quota long, share double")
    place = F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1 << 40))
    near = named.select("lang", "id").join(F.broadcast(plan), "lang") \
        .where(place < F.col("share") * float(1 << 40)).distinct()
    first = F.row_number().over(Window.partitionBy("lang").orderBy(place, "id"))
    return near.withColumn("rank", first).where("rank <= quota").select("lang", "id")


def fit(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        sample_rows: int = SAMPLE_ROWS, max_words: int = MAX_WORDS, max_grams: int = MAX_GRAMS,
        max_langs: int = MAX_LANGS) -> dict:
    """Word and n-gram log frequencies by language, from the given training rows."""
    named = rows.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")) \
        .where("lang is not null and text is not null and id is not null")
    held = {r.lang: r["count"] for r in named.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_langs).collect()}
    if not held:
        return {"langs": []}
    taught = sample_by_language(named, held, sample_rows)
    some = named.join(F.broadcast(taught), ["lang", "id"]).select("lang", "text")
    counts = some.mapInPandas(_count_udf, "lang string, kind int, item string, n long") \
        .groupBy("lang", "kind", "item").agg(F.sum("n").alias("n"))
    totals = F.expr("sum(n) over (partition by lang, kind)")
    top = counts.where("n > 1 or kind > 0").withColumn("total", totals).withColumn(
        "rank", F.expr("row_number() over (partition by lang, kind order by n desc, item)")) \
        .where((F.col("rank") <= F.when(F.col("kind") == 0, max_words).otherwise(max_grams)))
    table = top.select("lang", "kind", "item", "n", "total").toPandas()
    langs = sorted(set(table["lang"]))
    at = {x: i for i, x in enumerate(langs)}
    model: dict = {"langs": langs}
    for name, part in (("words", table[table.kind == 0]), ("grams", table[table.kind > 0])):
        items = {x: i for i, x in enumerate(sorted(set(part["item"])))}
        floor = np.ones((len(items), len(langs)))
        size = np.ones((len(items), len(langs)))
        total = {(r.lang, r.kind): r.total for r in part.drop_duplicates(["lang", "kind"]).itertuples()}
        kinds = {x: 0 if name == "words" else len(x) for x in items}
        vocabulary = Counter(kinds.values())
        for x, i in items.items():
            size[i] = [total.get((lang, kinds[x]), 0) + vocabulary[kinds[x]] for lang in langs]
        for r in part.itertuples():
            floor[items[r.item], at[r.lang]] = r.n + 1
        model[name] = items
        model[name + "_log"] = np.log(floor / size).astype(np.float32)
    return model


class _Memo(dict):
    """word -> row of the matrix of per-language sums."""

    def __init__(self, model: dict):
        super().__init__()
        self.model = model
        self.sums = np.zeros((MEMO_LIMIT, len(model["langs"])), np.float32)

    def reset(self) -> None:
        if len(self) > MEMO_LIMIT // 2:
            self.clear()

    def __missing__(self, word: str) -> int:
        i = len(self)
        if i == len(self.sums):  # one text with more words than the bound: grow for this text
            self.sums = np.concatenate([self.sums, np.zeros_like(self.sums)])
        known = self.model["words"].get(word)
        if known is not None:
            self.sums[i] = self.model["words_log"][known]
        else:
            grams = cover(word, self.model["grams"])
            self.sums[i] = self.model["grams_log"][grams].sum(axis=0) if grams else 0
        self[word] = i
        return i


def predict_udf(model):
    """text -> (lang_pred, score); ``model`` is a broadcast of ``fit``'s result."""
    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = model.value
        memo = _Memo(m) if m["langs"] else None
        for batch in batches:
            out = []
            for text in batch:
                words = words_of(text)
                if memo is None or not any(c.isalpha() for w in words for c in w):
                    out.append(("und", 0.0))
                    continue
                memo.reset()
                rows = [memo[w] for w in words]
                total = memo.sums[rows].sum(axis=0, dtype=np.float64)
                best = int(total.argmax())
                mean = (total - total[best]) * (min(len(words), EVIDENCE) / len(words))
                out.append((m["langs"][best], 1.0 / math.fsum(np.exp(np.maximum(mean, -700.0)).tolist())))
            yield pd.DataFrame(out, columns=["lang_pred", "score"])
    return predict


def identify(docs: DataFrame, model: dict, text_col: str = "text", result: str = "language") -> DataFrame:
    """``docs`` with a struct column ``result``: lang_pred, score."""
    return docs.withColumn(result, predict_udf(docs.sparkSession.sparkContext.broadcast(model))(F.col(text_col)))


def language_report(docs: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learns from rows outside the held-out fold only."""
    fold = id_bucket(F.col("doc_id"), folds)
    model = fit(docs.where(fold != held))
    named = docs.select("doc_id", "text", F.coalesce(fold == held, F.lit(False)).alias("held_out"))
    return identify(named, model).select("doc_id", "held_out", "language.lang_pred", "language.score")
