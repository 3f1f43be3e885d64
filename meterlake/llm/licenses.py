"""License scans: normalised text against license templates by the Dice coefficient of
word bigrams, on built-in functions only.

Texts are lower-cased and reduced to words of letters and digits. Units of comparison are
the lines, the paragraphs and the whole text, and inside them the sentences and the word
windows of each template's length. A window that reaches the threshold shares enough bigrams that
one of them is among the ``marks`` of the template (its rarest-looking bigrams, by the same
bound), so only windows that contain such a bigram are compared, and only in texts that have one
and whose outer units do not match exactly already. Comment leaders fall to the word rule;
``rem`` and ``dnl`` at the start of a line are dropped for the windows. A template can reach the threshold ``t``
only for units whose bigram count lies between t/(2-t) and (2-t)/t times its own, so other
templates are pruned by size. A unit that reaches it also shares enough bigrams that one of
them contains an anchor word of the template (the bound is checked when the templates are
prepared); texts without any anchor word are settled by a plain substring test.

Everything is computed inside the row: no shuffle, and no group to be skewed. The
templates are a fixed short list, or a caller's list of at most ``MAX_TEMPLATES``.

Defined results: NULL, empty and license-free texts give no license and a Dice of 0; ties go
to the outer units, there to the first template name in order, and inside to the longest
template; units of one word have no bigrams and never match;
repeated rows get equal results; only the id and the text column are read.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
MAX_TEMPLATES = 200

#: Notices and short licenses, by SPDX name.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                         "compliance with the License. You may obtain a copy of the License at "
                         "http://www.apache.org/licenses/LICENSE-2.0",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "Released under the CC0 1.0 Universal license.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
           "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
                "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
                "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
                "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Proprietary": "All rights reserved. Unauthorized copying of this file is strictly prohibited.",
}
#: Words that mark license text; every template must be reachable through them.
ANCHORS = ("license", "licence", "licensed", "copyright", "permission", "gnu", "reserved", "cc", "mit")


def template_words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def template_bigrams(text: str) -> list[str]:
    words = template_words(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def anchors_of(templates: dict[str, str], threshold: float) -> list[str]:
    """Words one of which stands in every unit that reaches the threshold.

    Such a unit shares at least k = ceil(t/(2-t) * size) bigrams with the template, so any
    size-k+1 of the template's bigrams include a shared one; the anchors must touch that many."""
    need: list[str] = []
    for name, text in templates.items():
        grams = template_bigrams(text)
        least = len(grams) - math.ceil(threshold / (2 - threshold) * len(grams) - 1e-9) + 1
        own: list[str] = []
        words = sorted(set(template_words(text)), key=lambda w: (w not in ANCHORS, -len(w), w))
        for w in words:
            if sum(any(a in g.split() for a in own) for g in grams) >= least:
                break
            own.append(w)
        need += own
    return sorted(set(need))


def marks_of(text: str, threshold: float) -> list[str]:
    """Bigrams one of which every unit shares that reaches the threshold; those with long and anchor words first."""
    grams = template_bigrams(text)
    least = len(grams) - math.ceil(threshold / (2 - threshold) * len(grams) - 1e-9) + 1
    return sorted(grams, key=lambda g: (not any(w in ANCHORS for w in g.split()), -len(g), g))[:least]


def normalise(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def _bigrams(words: Column) -> Column:
    return F.array_distinct(F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))),
                                       F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))),
                                       lambda a, b: F.concat_ws(" ", a, b)))


#: Between words; a leader word of a comment line goes with the blanks before it.
GAP = r"[^a-z0-9]+(?:(?:rem|dnl)(?<=\n[ \t]{0,20}(?:rem|dnl))[^a-z0-9]+)*"
SENTENCE_END = r"(?<=[.!?])\s+"


def _inner_license(text: Column, templates: dict[str, str], threshold: float) -> Column:
    """struct<dice, license>: the best template of any sentence or template-sized window of words."""
    held = {n: t for n, t in sorted(templates.items(), key=lambda x: (-len(template_bigrams(x[1])), x[0])) if template_bigrams(t)}
    result = "struct<dice:double,license:string>"
    none = F.struct(F.lit(0.0).alias("dice"), F.lit(None).cast("string").alias("license")).cast(result)
    if not held:
        return none
    plan = F.array(*[F.struct(F.lit(n).alias("license"), F.lit(len(template_words(t))).alias("size"),
                              F.array(*[F.lit(g) for g in template_bigrams(t)]).alias("own"),
                              F.array(*[F.lit(g) for g in marks_of(t, threshold)]).alias("marks")) for n, t in held.items()])
    after: dict[str, set] = {}
    for t in held.values():
        for a, b in (g.split() for g in marks_of(t, threshold)):
            after.setdefault(a, set()).add(b)
    mark = "(?:^| )(?:" + "|".join(f"{a} (?:{'|'.join(sorted(b))})" for a, b in sorted(after.items())) + ")(?: |$)"
    bind = lambda value, fn: F.element_at(F.transform(F.array(value), fn), 1)
    dice = lambda g, t: 2.0 * F.size(F.array_intersect(g, t["own"])) / (F.size(g) + F.size(t["own"]))
    zero = F.lit(0.0)

    def windows(words: Column, pairs: Column, t: Column) -> Column:
        at = F.filter(F.sequence(F.lit(1), F.size(pairs)), lambda i: F.array_contains(t["marks"], F.element_at(pairs, i)))
        last = F.size(words) - t["size"] + 1
        starts = F.array_distinct(F.flatten(F.transform(F.filter(at, lambda i: last >= 1), lambda i: F.sequence(
            F.least(F.greatest(i - t["size"] + 2, F.lit(1)), last), F.least(i, last)))))
        return F.aggregate(starts, zero, lambda best, k: F.greatest(best, dice(
            F.array_distinct(F.slice(pairs, k, t["size"] - 1)), t)))

    def search(norm: Column) -> Column:
        def of_pairs(words, pairs, sentences):
            def of_template(best, t):
                inside = F.aggregate(sentences, zero, lambda a, g: F.greatest(a, dice(g, t)))
                found = F.when(F.arrays_overlap(pairs, t["marks"]), F.greatest(windows(words, pairs, t), inside)).otherwise(zero)
                return bind(found, lambda x: F.when((x >= threshold) & (x > best["dice"]), F.struct(
                    x.alias("dice"), t["license"].alias("license")).cast(result)).otherwise(best))
            return F.aggregate(plan, none, of_template)
        pair = lambda w: F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1),
                                    lambda a, b: F.concat_ws(" ", a, b))
        sentences = F.transform(F.split(text, SENTENCE_END), lambda u: _bigrams(F.split(normalise(u), " ")))
        return bind(F.split(norm, " "), lambda w: bind(pair(w), lambda g: bind(
            F.filter(sentences, lambda x: F.size(x) > 0), lambda x: of_pairs(w, g, x))))

    return bind(F.trim(F.regexp_replace(F.lower(text), GAP, " ")), lambda norm: F.when(norm.rlike(mark), search(norm)).otherwise(none))


def best_license(text: Column, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> Column:
    """struct<dice, license>: the best template of any unit, NULL below the threshold."""
    if len(templates) > MAX_TEMPLATES:
        raise ValueError(f"at most {MAX_TEMPLATES} templates")
    grams = {n: template_bigrams(t) for n, t in sorted(templates.items())}
    anchors = anchors_of(templates, threshold)
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    most = math.floor(max(map(len, grams.values())) * high + 1e-9)
    least = math.ceil(min(map(len, grams.values())) * low - 1e-9)
    words_of = lambda unit: F.split(normalise(unit), " ")
    marked = lambda unit: F.arrays_overlap(words_of(unit), F.array(*[F.lit(a) for a in anchors]))
    # a unit of k distinct bigrams has more than k words; longer units may repeat some, so only the lower bound holds for words
    units = F.concat(F.split(text, "\n"), F.split(text, r"\n\s*\n"), F.array(text))
    units = F.array_distinct(F.filter(units, marked))
    sets = F.filter(F.transform(units, lambda u: _bigrams(words_of(u))), lambda g: F.size(g).between(least, most))
    result = "struct<dice:double,license:string>"

    def against(g: Column) -> Column:
        scores = []
        for name, own in grams.items():
            dice = 2.0 * F.size(F.array_intersect(g, F.array(*[F.lit(x) for x in own]))) / (F.size(g) + len(own))
            fits = F.size(g).between(math.ceil(low * len(own) - 1e-9), math.floor(high * len(own) + 1e-9))
            scores.append(F.struct(F.when(fits, dice).otherwise(0.0).alias("dice"), F.lit(name).alias("license")).cast(result))
        first = scores[0]
        best = F.aggregate(F.array(*scores[1:]), first, lambda a, b: F.when(b["dice"] > a["dice"], b).otherwise(a))
        return best

    every = F.transform(sets, against)
    none = F.struct(F.lit(0.0).alias("dice"), F.lit(None).cast("string").alias("license")).cast(result)
    best = F.aggregate(every, none, lambda a, b: F.when((b["dice"] >= threshold) & (
        (b["dice"] > a["dice"]) | ((b["dice"] == a["dice"]) & (b["license"] < a["license"]))), b).otherwise(a))
    pick = lambda outer: F.when(outer["dice"] >= 1.0, outer).otherwise(F.element_at(F.transform(
        F.array(_inner_license(text, templates, threshold)), lambda i: F.when(i["dice"] > outer["dice"], i).otherwise(outer)), 1))
    best = F.element_at(F.transform(F.array(best), pick), 1)
    lowered = F.lower(text)
    any_anchor = lowered.contains(anchors[0])
    for a in anchors[1:]:
        any_anchor = any_anchor | lowered.contains(a)
    return F.when(any_anchor, best).otherwise(none)


def license_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """doc_id, license, dice, licensed."""
    found = docs.select(F.col(id_col).alias("doc_id"), best_license(F.col(text_col), **kw).alias("b"))
    return found.select("doc_id", F.col("b.license").alias("license"), F.coalesce("b.dice", F.lit(0.0)).alias("dice"),
                        F.col("b.license").isNotNull().alias("licensed"))


def oracle(templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The same report in DuckDB SQL, without any pruning."""
    rows = ", ".join("('{}', [{}])".format(n, ", ".join(f"'{g}'" for g in template_bigrams(t))) for n, t in sorted(templates.items()))
    return f"""WITH templates(license, own) AS (VALUES {rows}),
    d AS (SELECT row_number() OVER () AS row_id, doc_id, text FROM documents),
    units AS (SELECT DISTINCT row_id, u FROM (
      SELECT row_id, unnest(list_concat(string_split(text, chr(10)), string_split_regex(text, '\\n\\s*\\n'), [text])) AS u
      FROM d WHERE text IS NOT NULL)),
    words AS (SELECT row_id, string_split(trim(regexp_replace(lower(u), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM units),
    grams AS (SELECT row_id, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM words WHERE len(w) > 1),
    scores AS (SELECT row_id, license, 2.0 * len(list_intersect(g, own)) / (len(g) + len(own)) AS dice FROM grams, templates),
    best AS (SELECT row_id, license, CAST(dice AS DOUBLE) AS dice FROM scores WHERE dice >= {threshold}
      QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY dice DESC, license) = 1)
    SELECT doc_id, license, coalesce(dice, CAST(0 AS DOUBLE)) AS dice, license IS NOT NULL AS licensed FROM d LEFT JOIN best USING (row_id)"""
