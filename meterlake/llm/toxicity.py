"""Toxicity by a weighted finite-state pattern grammar.

A lexical transducer (whole words and word stems) maps words to classes: insult, weak
insult (a stem that clean texts hold by chance, too), threat, target, negation, reported
speech, clause end, other. Small machines read the class string: one remembers a target,
one a negation in the last words, one a reporting verb of the clause. They are composed
once into a single deterministic machine, and an insult (weak or not) or threat emits an event that
carries the context (targeted, negated, reported) of its clause, so clauses are scored
and not isolated words. A document's score is the logistic function of the weighted event
counts and of how far weak insults that are neither negated nor reported exceed their chance number in a text of that length.

Learned from a bounded sample of ``sample_rows`` labels, the only bound: the insult lexicon
(words or stems far more frequent in toxic texts, next to a few fixed seed words) and the event weights (ridge-penalised towards the grammar's prior).
Near copies in the sample count once per label: rows whose signatures over four-word shingles
(those of ``near_dup``) agree on 0.8 of the slots, by the first of them; texts without words are one.

Defined results: NULL and empty texts score as texts without events; labels that are NULL
or have a NULL id teach nothing; conflicting labels of one id each count; scoring reads the
whole text, however long, and no other column, so their names cannot clash.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.llm.common import cut, id_bucket, sample_ids
from meterlake.llm.near_dup import signature_udf

SAMPLE_ROWS = 10_000

OTHER, INSULT, WEAK, THREAT, TARGET, NEGATION, REPORT, END = range(8)
#: Seed words of each class.
SEEDS = {
    INSULT: "idiot idiots moron morons stupid scum loser losers pathetic worthless disgusting trash imbecile "
            "dumb idiota imbécil estúpido basura idioten dumm dummkopf abschaum imbécile stupide crétin ordure",
    THREAT: "kill hurt destroy beat shoot stab strangle burn töten umbringen schlagen tuer frapper matar golpear",
    TARGET: "you your yours yourself they them their he him she her du dich dir dein ihr euch sie tu te toi vous "
            "ton ta votre tú ti usted ustedes vuestro",
    NEGATION: "not no never none neither nor isn't aren't don't doesn't cannot nicht kein keine nie niemals ne pas "
              "jamais aucun nunca jamás ningún",
    REPORT: "said says say called calls quoted quote wrote claimed alleged sagte sagt schrieb zitiert dit disait "
            "écrit dijo dice escribió",
}
TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.!?;\n]")
ENDS = {".", "!", "?", ";", "\n"}
#: Words after a negation that it still covers.
SCOPE = 3

# Machines: state -> {class: next state}; a class that is not named keeps the state.
TARGET_MACHINE = {0: {TARGET: 1}, 1: {END: 0}}
REPORT_MACHINE = {0: {REPORT: 1}, 1: {END: 0}}
NEGATION_MACHINE = {0: {NEGATION: SCOPE}} | {
    s: {NEGATION: SCOPE, END: 0} | {c: s - 1 for c in (OTHER, INSULT, WEAK, THREAT, TARGET, REPORT)} for s in range(1, SCOPE + 1)}
#: Events: (class, targeted, negated, reported); a threat needs a target to count as one, the weight of weak insults is learned alone.
EVENTS = list(product((INSULT, THREAT, WEAK), (0, 1), (0, 1), (0, 1)))
#: Bands and slots a band of the signatures that find near copies among the labelled rows, and the share of slots that must agree.
COPY_BANDS, COPY_AGREEMENT = (40, 6), 0.8
#: Letters of a learned stem.
STEM = range(3, 11)
#: Words whose class a task may remember.
MEMO_LIMIT = 300_000
#: Prior weight of an event of each kind, and of none.
PRIOR_BIAS = -3.0


def prior_weights() -> np.ndarray:
    out = []
    for kind, targeted, negated, reported in EVENTS:
        w = (3.0 + targeted) if kind == INSULT else 3.5 if kind == THREAT and targeted else 0.0
        out.append(w * (0.4 if negated else 1.0) * (0.4 if reported else 1.0))
    return np.array([PRIOR_BIAS, 0.0, 0.0, *out])


def compose(*machines: dict) -> tuple[list[list[int]], list[tuple[int, ...]]]:
    """Product of deterministic machines over the class alphabet: transition table and state tuples."""
    states, todo, table = {tuple(0 for _ in machines): 0}, [tuple(0 for _ in machines)], []
    while todo:
        here = todo.pop(0)
        row = []
        for c in range(END + 1):
            to = tuple(m[s].get(c, s) for m, s in zip(machines, here, strict=True))
            if to not in states:
                states[to] = len(states)
                todo.append(to)
            row.append(states[to])
        table.append(row)
    return table, list(states)


TABLE, STATES = compose(TARGET_MACHINE, NEGATION_MACHINE, REPORT_MACHINE)
EVENT_AT = {e: i for i, e in enumerate(EVENTS)}


def lexicon(learned: list[tuple[str, int]]) -> dict[str, int]:
    """pattern -> class; a pattern is a word and ``$``, or a stem."""
    out = {w + "$": c for c, words in SEEDS.items() for w in words.split()}
    return out | {p: c for p, c in learned if out.get(p, c) == c or out.get(p) == INSULT}


class Lexical(dict):
    """The lexical transducer: class of a word, remembered; whole words before the longest stem."""

    def __init__(self, patterns: dict[str, int]):
        super().__init__()
        self.patterns = patterns

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO_LIMIT:
            self.clear()
        get = self.patterns.get
        c = END if word in ENDS else get(word + "$", OTHER)
        if not c:
            for n in range(min(len(word), STEM[-1]), STEM[0] - 1, -1):
                c = get(word[:n], OTHER)
                if c:
                    break
        self[word] = c
        return c


def events_of(text: str | None, lexical: Lexical) -> tuple[np.ndarray, int, int]:
    """Event counts of the composed machine over the whole text, clause by clause; weak
    insults that are neither negated nor reported; words.

    A target counts for its whole clause, also when it follows the insult or threat."""
    counts, weak = np.zeros(len(EVENTS), np.int64), 0
    tokens = TOKEN.findall(text.lower()) if text else []
    classes = [lexical[w] for w in tokens]
    if INSULT not in classes and THREAT not in classes and WEAK not in classes:
        return counts, 0, len(tokens)
    state, before, clause = 0, -1, []
    for i, c in enumerate([*classes, END]):
        if c == OTHER:
            continue
        for _ in range(min(i - before - 1, SCOPE)):
            state = TABLE[state][OTHER]
        before = i
        targeted, negation, reported = STATES[state]
        if c in (INSULT, THREAT, WEAK):
            clause.append((c, int(negation > 0), reported))
            weak += c == WEAK and not negation and not reported
        elif c == END:
            for kind, negated, said in clause:
                counts[EVENT_AT[kind, targeted, negated, said]] += 1
            clause = []
        state = TABLE[state][c]
    return counts, weak, len(tokens)


def _features(counts, weak, words, chance: float) -> np.ndarray:
    """Bias, weak insults, weak insults against their chance number, events (every one adds, by the square root of their number)."""
    counts, weak, words = np.atleast_2d(counts), np.atleast_1d(weak), np.atleast_1d(words)
    excess = np.where(weak > 0, np.log((weak + 0.5) / (words * chance + 0.5)), 0.0)
    return np.column_stack([np.ones(len(weak)), np.minimum(np.log1p(weak), 4.0), np.clip(excess, -3.0, 4.0),
                            counts ** 0.5])


def _pattern_udf():
    @F.pandas_udf("array<string>")
    def found(texts: pd.Series) -> pd.Series:
        """Words and stems of each text (``#2``: those that occur twice)."""
        patterns = []
        for t in texts:
            words = Counter(w for w in TOKEN.findall((t or "").lower()) if w not in ENDS)
            seen: Counter = Counter()
            for w, n in words.items():
                if len(w) >= STEM[0]:
                    seen[w + "$"] += n
                    for k in range(STEM[0], min(STEM[-1], len(w)) + 1):
                        seen[w[:k]] += n
            patterns.append([*seen, *(p + "#2" for p, n in seen.items() if n > 1)])
        return pd.Series(patterns)
    return found


def copy_leaders(sketches: list[bytes]) -> list[int]:
    """For every signature (one byte a slot) the place of the first one that agrees with it on
    ``COPY_AGREEMENT`` of the slots and shares a band; its own place if there is none."""
    width = COPY_BANDS[1]
    slots = [np.frombuffer(s, np.uint8) for s in sketches]
    buckets: dict[tuple[int, bytes], list[int]] = {}
    out = []
    for i, sketch in enumerate(sketches):
        bands = [(b, sketch[b * width:(b + 1) * width]) for b in range(COPY_BANDS[0])]
        seen = sorted({j for b in bands for j in buckets.get(b, ())})
        lead = next((j for j in seen if (slots[i] == slots[j]).mean() >= COPY_AGREEMENT), i)
        if lead == i:
            for b in bands:
                buckets.setdefault(b, []).append(i)
        out.append(lead)
    return out


def without_copies(labelled: DataFrame) -> DataFrame:
    """One (toxic, text) row of each group of near copies and label of the bounded sample.

    Only the signatures of the sample (240 bytes a row) are grouped, on the driver."""
    # the row number is fixed by the checkpoint
    rows = cut(labelled.select(F.col("toxic").cast("int").alias("toxic"), "text", signature_udf(4, *COPY_BANDS)("text").alias("s"))
               .select("toxic", "text", F.col("s.sketch").alias("sketch")).withColumn("row", F.monotonically_increasing_id()))
    found = sorted(rows.select("row", "toxic", "sketch").collect())
    worded = [r for r in found if r.sketch is not None]
    leaders = copy_leaders([bytes(r.sketch) for r in worded])
    first: dict[tuple[int, int], int] = {}
    for r, lead in [*zip(worded, leaders, strict=True), *((r, -1) for r in found if r.sketch is None)]:
        first.setdefault((lead, r.toxic), r.row)
    kept = rows.sparkSession.createDataFrame([(x,) for x in first.values()], "row long")
    return rows.join(F.broadcast(kept), "row", "left_semi").select("toxic", "text")


def learn_insults(some: DataFrame) -> list[tuple[str, int]]:
    """Words and stems far more frequent in toxic than in other texts of the sample, with their class.

    Ranked by the log-likelihood ratio of the two rates of texts that hold them once, or
    twice, at least; nested patterns are taken once."""
    n = {r.toxic: r["count"] for r in some.groupBy("toxic").count().collect()}
    bad, good = n.get(1, 0), n.get(0, 0)
    if not bad or not good:
        return []
    rows = some.select("toxic", F.explode("patterns").alias("p")).groupBy("p").agg(
        F.sum(F.col("toxic")).alias("a"), F.sum(1 - F.col("toxic")).alias("b")) \
        .where((F.col("a") >= max(5, 0.005 * bad)) & (F.col("a") * good > 6 * F.col("b") * bad))
    part = lambda k, e: F.when(k > 0, k * F.log(k / e)).otherwise(0.0)
    a, b = F.col("a"), F.col("b")
    rate = (a + b) / (bad + good)
    gain = part(a, rate * bad) + part(b, rate * good) + part(bad - a, (1 - rate) * bad) + part(good - b, (1 - rate) * good)
    top = rows.withColumn("gain", gain).where("gain > 12").orderBy(F.desc("gain"), F.length("p").desc(), "p").collect()
    by_chance = {r.p: r.b for r in top}
    out: list[tuple[str, int]] = []
    for r in top:
        p = r.p.removesuffix("#2")
        if not any(q.startswith(p.rstrip("$")) or p.startswith(q.rstrip("$")) for q, _ in out):
            out.append((p, INSULT if by_chance.get(p, good) <= 0.0005 * good else WEAK))
    return out


def _fit_weights(x: np.ndarray, y: np.ndarray, prior: np.ndarray, pull: float = 0.3) -> np.ndarray:
    """Logistic regression of event features by Newton steps, penalised towards the prior."""
    w = prior.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + pull * (w - prior)
        hess = (x * (p * (1 - p))[:, None]).T @ x + pull * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


def _event_udf(patterns):
    @F.pandas_udf("events array<long>, weak long, words long")
    def events(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        lexical = Lexical(patterns.value)
        for texts in batches:
            found = [events_of(t, lexical) for t in texts]
            yield pd.DataFrame({"events": [x[0] for x in found], "weak": [x[1] for x in found],
                                "words": [x[2] for x in found]})
    return events


def fit(labelled: DataFrame) -> dict:
    """Lexicon and event weights from a bounded sample of (text, toxic) rows."""
    some = cut(without_copies(labelled).withColumn("patterns", _pattern_udf()("text")))
    patterns = lexicon(learn_insults(some))
    held = some.sparkSession.sparkContext.broadcast(patterns)
    # one small row per text of the bounded sample
    seen = some.select("toxic", _event_udf(held)("text").alias("e")).select("toxic", "e.*").toPandas()
    prior = prior_weights()
    clean = seen[seen.toxic == 0]
    chance = float(clean["weak"].sum() / max(1, clean["words"].sum()))
    if len(seen):
        x = _features(np.array(seen["events"].tolist()), seen["weak"].to_numpy(), seen["words"].to_numpy(), chance)
        weights = _fit_weights(x, seen["toxic"].to_numpy(float), prior)
    return {"patterns": patterns, "chance": chance, "weights": weights if len(seen) else prior}


def score_udf(model):
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = model.value
        lexical = Lexical(m["patterns"])
        for texts in batches:
            found = [events_of(t, lexical) for t in texts]
            x = _features(np.array([f[0] for f in found]).reshape(len(found), len(EVENTS)), np.array([f[1] for f in found]),
                          np.array([f[2] for f in found]), m["chance"])
            yield pd.Series(1 / (1 + np.exp(-np.clip(x @ m["weights"], -30, 30))))
    return score


def score_documents(docs: DataFrame, model: dict, text_col: str = "text", result: str = "toxicity") -> DataFrame:
    """``docs`` with a double column ``result``."""
    return docs.withColumn(result, score_udf(docs.sparkSession.sparkContext.broadcast(model))(F.col(text_col)))


def labelled_rows(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0,
                  sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(text, toxic) of at most ``sample_rows`` labels outside the held-out fold."""
    taught = labels.select(F.col("doc_id").alias("id"), "toxic") \
        .where("toxic in (0, 1) and id is not null").where(id_bucket(F.col("id"), folds) != held)
    some = sample_ids(taught, sample_rows)
    return docs.select("doc_id", "text").join(F.broadcast(some), F.col("doc_id") == F.col("id")).select("text", "toxic")


def toxicity_report(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    model = fit(labelled_rows(docs, labels, folds, held))
    named = docs.select("doc_id", "text", F.coalesce(id_bucket(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out"))
    return score_documents(named, model).select(
        "doc_id", "held_out", F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
