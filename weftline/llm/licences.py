"""Licence scan: a trained paragraph classifier with template comparison, DataFrame operations only.

Windows: the wrapped lines of a paragraph (blank lines end it) are joined by a space, with comment
marks left out; paragraphs longer than `WINDOW` words are cut into windows that overlap by half. The
lines and the sentences of a paragraph of several are windows too ("pieces"), for notices that stand
beside others; a piece counts only when it is confirmed and less than half of its family's 3-grams are
in the templates of a family that is confirmed for its paragraph ("General Public License" behind
"GNU Lesser" adds no GPL).

Which windows are scored: those that hold at least one word 3-gram of a template (or a whole template
of fewer words). Confirmation asks for at least half of the 3-grams of window or template, so a
window without any cannot be confirmed, whatever its score: nothing is lost by leaving it out. A
document is searched for template 3-grams by their hashes in one pass over its words.

Classifier: multinomial logistic regression on sparse word 1-, 2- and 3-grams, the vocabulary being
those of the training rows, so that words it never saw weigh nothing. It is trained here on the
template sentences below, single and joined to notices, with words dropped, added and swapped,
against sentences that use the same words for something else and against the same words in no
order. Its temperature, and the bound on the probability that lets at most `FALSE_SHARE` of the
unknowns pass, are fitted on rows that training has not seen: changed variants of the notices, and
variants of counter-sentences that were left out of training altogether.

A prediction counts when the templates confirm it: at least `CONTAINED` of the window's word
3-grams occur in the templates of the predicted family, or, for a window longer than a template, at
least `CONTAINED` of one template's.

The vocabulary (`VOCABULARY` n-grams at most, by family) and the template 3-grams are tables of
fixed size, broadcast. Only windows that are scored are exploded; all other rows pass with zeros.

Edge cases: a null text counts as empty and has no licence. Rows may repeat and ids may be null;
each row gets its own result. An empty table gives an empty result. A very long text is searched
whole, in its own row. Only id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import json
import random
import re
from collections import Counter
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.arrays import let
from weftline.llm.rows import column
from weftline.staging import stage

WINDOW, CONTAINED, FALSE_SHARE, SEED, VOCABULARY = 40, 0.5, 0.01, 7, 8192

# The wording of public licence notices, by family.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "The software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement.",
        "In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "See the License for the specific language governing permissions and limitations under the License.",
        "Released under the Apache License 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "Released under the GPL version 3.",
        "Licensed under GPLv3.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "LGPL": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "Released under the LGPL version 3.",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ),
    "AGPL": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "Released under the AGPL version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ),
    "BSD": (
        "Licensed under the BSD 3-Clause License.",
        "Released under the BSD license.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "MPL": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Released under the ISC License.",
        "SPDX-License-Identifier: ISC",
    ),
    "CC-BY": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "You are free to share, copy and redistribute the material in any medium or format, and to adapt, remix, transform and build upon the material for any purpose, even commercially.", "SPDX-License-Identifier: CC-BY-4.0"),
    "CC-BY-SA": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"),
    "CC-BY-NC": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "EPL": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        "Licensed under the Eclipse Public License, version 2.0.",
        "SPDX-License-Identifier: EPL-2.0",
    ),
    "BSL": (
        "Distributed under the Boost Software License, Version 1.0.",
        "See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt",
        "SPDX-License-Identifier: BSL-1.0",
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely.",
        "Released under the zlib license.",
        "SPDX-License-Identifier: Zlib",
    ),
    "public-domain": ("Released under CC0 1.0.", "This work is dedicated to the public domain under CC0 1.0 Universal.", "This is free and unencumbered software released into the public domain.", "Released under the Unlicense.", "SPDX-License-Identifier: CC0-1.0"),
    "proprietary": ("All rights reserved.", "Copyright 2020 Example Inc. All rights reserved.", "No part of this work may be reproduced without the prior written permission of the copyright holder."),
}
# Sentences that use the same words for something else.
OTHERS = (
    "A driving license is required to rent a car in this city.", "She renewed her fishing license last week.", "The apache helicopter landed near the village.",
    "He asked for permission to leave the room.", "Copyright law was debated in parliament for years.", "Researchers at MIT published a new study on batteries.",
    "The rights of the child were discussed at length.", "The general public was invited to the opening of the museum.", "The warranty on the washing machine covers two years.",
    "The creative commons of the village was used for grazing.", "This domain of knowledge is hard to enter.", "The Mozilla developers met in Berlin.",
    "Human rights groups asked for an inquiry.", "The license plate of the car was missing.", "The bar lost its liquor license.", "We redistribute food to families in need.",
    "BSD stands for many things in medicine.", "The copyright page of the book was torn.", "Civil rights were at the centre of the speech.", "The gnu is a large antelope.",
    "Parking is by permission of the owner only.", "The domain name was registered in 1999.", "The software version was updated to 3.1 last year.", "Voting rights are granted at eighteen.",
)

FAMILIES = ("unknown", *TEMPLATES)
NOT_WORD = "[^a-z0-9.+-]+"
#: A line end with the comment marks and blanks before the next line's text.
LINE_END = r"\n[ \t\r*#/%;>|-]*"
PARAGRAPH_END = rf"{LINE_END}(?:{LINE_END})+"
SENTENCE_END = r"(?<=[.!?;])[ \t]+"
HYPHENATED, WRAPPED = rf"(?<=[A-Za-z])-[ \t\r]*{LINE_END}", rf"[ \t\r]*{LINE_END}"


def words_of(text: str) -> list[str]:
    """The words as `word_column` gives them."""
    return [w for w in re.split(NOT_WORD, re.sub(r"[.](?![a-z0-9])", " ", text.lower())) if w]


def grams_of(words: list[str], longest: int = 3) -> set[str]:
    return {" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)}


def cuts(words: list[str]) -> list[list[str]]:
    """Windows of WINDOW words that overlap by half."""
    half = WINDOW // 2
    return [words[i * half : i * half + WINDOW] for i in range(max(0, (len(words) - 1 - half) // half) + 1)]


def _changed(words: list[str], rng: random.Random, filler: list[str]) -> list[str]:
    """Words dropped, and others put before, behind or between."""
    found = [w for w in words if rng.random() > 0.08] or list(words)
    for _ in range(rng.randrange(1, 12)):
        found.insert(rng.choice((0, len(found))) if rng.random() < 0.9 else rng.randrange(len(found) + 1), rng.choice(filler))
    return found


def _rows(rng: random.Random, n: int, others: tuple[str, ...], unchanged: bool) -> list[tuple[tuple[str, ...], int]]:
    """Windows and their families: n variants of each sentence and notice, and 12 n of words in no order."""
    known = [words_of(s) for group in TEMPLATES.values() for s in group]
    in_notices = {w for words in known for w in words}
    filler = sorted({w for s in OTHERS for w in words_of(s)} - in_notices) + [f"filler{i}" for i in range(40)]
    bases = [(words_of(s), 0) for s in others]
    for k, family in enumerate(FAMILIES[1:], 1):
        bases += [(w, k) for s in TEMPLATES[family] for w in cuts(words_of(s))]
        whole = [words_of(s) for s in TEMPLATES[family] if not s.startswith("SPDX")]
        bases += [(w, k) for i in range(len(whole) - 1) for w in cuts(whole[i] + whole[i + 1])]
    found = [(tuple(words), k) for words, k in bases] if unchanged else []
    found += [(tuple(_changed(words, rng, filler)), k) for words, k in bases for _ in range(n)]
    for _ in range(12 * n):
        pool = [w for s in rng.sample(known, 3) for w in s]
        found.append((tuple(rng.choice(pool) if rng.random() < 0.4 else rng.choice(filler) for _ in range(rng.randrange(6, 30))), 0))
    return found


def _matrix(rows: list[tuple[tuple[str, ...], int]], place: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    x = np.zeros((len(rows), len(place)), np.float32)
    for row, (words, _) in enumerate(rows):
        x[row, [place[g] for g in grams_of(list(words)) if g in place]] = 1
    return x, np.array([k for _, k in rows])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fitting_rows() -> tuple[list[tuple[tuple[str, ...], int]], list[tuple[tuple[str, ...], int]]]:
    """Rows to train on and rows to calibrate on; no row is in both, and no counter-sentence is."""
    rng = random.Random(SEED)
    train = _rows(rng, 5, tuple(s for i, s in enumerate(OTHERS) if i % 3), True)
    seen = {words for words, _ in train}
    return train, [r for r in _rows(rng, 3, OTHERS[::3], False) if r[0] not in seen]


@lru_cache(maxsize=1)
def model() -> tuple[dict[str, int], np.ndarray, np.ndarray, float]:
    """Vocabulary, weights (n-gram, family) and bias, both divided by the fitted temperature, and the bound on the probability."""
    train, held = fitting_rows()
    counts = Counter(g for words, _ in train for g in grams_of(list(words)))
    chosen = sorted((g for g, c in counts.items() if c > 1 and "filler" not in g), key=lambda g: (-counts[g], g))[:VOCABULARY]
    place = {g: i for i, g in enumerate(sorted(chosen))}
    x, y = _matrix(train, place)
    target = np.eye(len(FAMILIES), dtype=np.float32)[y]
    w, b = np.zeros((len(place), len(FAMILIES)), np.float32), np.zeros(len(FAMILIES), np.float32)
    scale = np.maximum(1, x.sum(1, keepdims=True)) ** 0.5
    for _ in range(120):
        g = (_softmax(x @ w + b) - target) / scale
        w -= 4.0 * (x.T @ g / len(x) + 1e-5 * w)
        b -= 2.0 * g.mean(0)
    held_x, held_y = _matrix(held, place)
    logits = held_x @ w + b
    temperature = min((float(-np.log(_softmax(logits / t)[np.arange(len(held_y)), held_y] + 1e-12).mean()), t) for t in np.arange(0.2, 3.01, 0.1))[1]
    p = _softmax(logits / temperature)
    passed = np.sort(p[held_y == 0][:, 1:].max(1))[::-1]
    bound = max(0.5, float(passed[int(FALSE_SHARE * len(passed))]))
    return place, np.round(w / temperature, 4), b / temperature, round(bound, 4)


def template_grams(family: str) -> list[set[str]]:
    """The word 3-grams of each template; a shorter template is one gram."""
    found = []
    for sentence in TEMPLATES[family]:
        words = words_of(sentence)
        found.append({" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))})
    return found


def word_column(text: Column) -> Column:
    """Lower-cased words; a full stop stays only inside a word or number."""
    parts = F.split(F.regexp_replace(F.lower(text), r"[.](?![a-z0-9])", " "), NOT_WORD)
    return F.filter(parts, lambda w: w != "")


def joined(text: Column) -> Column:
    """Wrapped lines as one."""
    return F.regexp_replace(F.regexp_replace(text, HYPHENATED, "-"), WRAPPED, " ")


def _literal(values: list) -> Column:
    return F.array(*[F.lit(v) for v in values])


def holds_template_gram(spark: SparkSession):
    """A test of arrays of words: whether a template's 3-gram, or a whole template of fewer words, is in it."""
    grams = sorted({g for family in TEMPLATES for group in template_grams(family) for g in group})
    three = [g.split(" ") for g in grams if g.count(" ") == 2]
    keys = ["\x01".join(g) for g in three]
    hashes = [r[0] for r in spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "i int, g string").select(_hash3(F.split("g", "\x01"), F.lit(0)), "i").orderBy("i").collect()]
    short = [g for g in grams if g.count(" ") < 2]
    threes, firsts = _literal(sorted(set(hashes))), _literal(sorted({g.split(" ")[0] for g in short}))
    spelled = _literal(short)

    def test(words: Column) -> Column:
        hashed = F.when(F.size(words) >= 3, F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: _hash3(words, i))).otherwise(F.array().cast("array<long>"))
        pairs = F.transform(words, lambda w, i: F.concat_ws(" ", w, F.get(words, i + 1)))
        return F.arrays_overlap(hashed, threes) | (F.arrays_overlap(words, firsts) & (F.arrays_overlap(pairs, spelled) | F.arrays_overlap(words, spelled)))

    return test


def _hash3(words: Column, i: Column) -> Column:
    return F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))


def windows(text: Column, holds) -> Column:
    """array<struct<unit, piece, words>> of the windows that hold a template gram; `unit` numbers the paragraphs."""
    half = WINDOW // 2

    def cut(words: Column, unit: Column, piece: bool) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(words) - 1 - half) / half)).cast("int"))
        return F.transform(starts, lambda i: F.struct(unit.alias("unit"), F.lit(piece).alias("piece"), F.slice(words, i * half + 1, WINDOW).alias("words")))

    def of(paragraph: Column, unit: Column) -> Column:
        lines, sentences = F.split(paragraph, LINE_END), F.split(joined(paragraph), SENTENCE_END)
        several = lambda parts: F.when(F.size(parts) > 1, parts).otherwise(F.array().cast("array<string>"))
        pieces = F.array_distinct(F.transform(F.concat(several(lines), several(sentences)), word_column))
        return F.concat(let(word_column(joined(paragraph)), lambda w: cut(w, unit, False)), F.flatten(F.transform(pieces, lambda w: cut(w, unit, True))))

    return F.filter(F.flatten(F.transform(F.split(text, PARAGRAPH_END), of)), lambda w: holds(w["words"]))


def _table(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A table of fixed size, as a literal of the plan."""
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")).alias("r")).select("r.*")


def scan_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row_no, doc_id, windows (only those that are scored); the only pass over the texts."""
    text, holds = F.coalesce(column(text_col), F.lit("")), holds_template_gram(docs.sparkSession)
    none = F.array().cast("array<struct<unit:int,piece:boolean,words:array<string>>>")
    # the words of each window follow one another in a line as it stands or in a joined paragraph
    paragraphs = lambda t: F.flatten(F.transform(F.split(t, PARAGRAPH_END), lambda p: word_column(joined(p))))
    found = let(text, lambda t: F.when(let(word_column(t), holds) | let(paragraphs(t), holds), windows(t, holds)).otherwise(none))
    return stage(docs.select(F.monotonically_increasing_id().alias("row_no"), column(id_col).alias("doc_id"), found.alias("windows")), "windows")


def classify(scanned: DataFrame) -> DataFrame:
    """row_no, window, family, probability, contained, confirmed of each scored window that counts.

    `window` holds the paragraph from bit 32 up, in bit 31 whether it is a piece, and its position.
    """
    spark = scanned.sparkSession
    place, weights, bias, bound = model()
    w = _table(spark, [{"gram": g, "w": [round(float(v), 4) for v in weights[p]]} for g, p in place.items()], "gram: string, w: array<double>")
    known = [{"family": k, "template": f"{k}.{i}", "gram": g, "of": len(grams)} for k, family in enumerate(FAMILIES) if k for i, grams in enumerate(template_grams(family)) for g in sorted(grams)]
    templates = _table(spark, known, "family: int, template: string, gram: string, of: int")

    number = F.shiftleft(F.col("w.unit").cast("long"), 32) + F.when(F.col("w.piece"), F.lit(1 << 31)).otherwise(F.lit(0)) + F.col("at")
    unit = scanned.where(F.size("windows") > 0).select("row_no", F.posexplode("windows").alias("at", "w")).select("row_no", number.alias("window"), "w.words")
    none = F.array().cast("array<string>")
    spelled = F.concat(*[F.when(F.size("words") >= n, _spelled(n)).otherwise(none) for n in (1, 2, 3)])
    grams = unit.select("row_no", "window", F.explode(F.array_distinct(spelled)).alias("gram"))
    sums = [F.sum(F.coalesce(F.element_at("w", k + 1), F.lit(0.0))).alias(f"s{k}") for k in range(len(FAMILIES))]
    scored = grams.join(F.broadcast(w), "gram", "left").groupBy("row_no", "window").agg(*sums)
    logits = F.array(*[F.col(f"s{k}") + float(bias[k]) for k in range(len(FAMILIES))])
    best = F.array_max(F.transform(logits, lambda z, k: F.struct(z.alias("z"), (-k).alias("k"))))
    total = F.aggregate(logits, F.lit(0.0), lambda a, z: a + F.exp(z - F.array_max(logits)))
    predicted = scored.select("row_no", "window", (-best["k"]).alias("family"), (1 / total).alias("probability"))

    threes = unit.select("row_no", "window", F.explode(F.array_distinct(F.when(F.size("words") >= 3, _spelled(3)).otherwise(F.array(F.array_join("words", " "))))).alias("gram"))
    size = threes.groupBy("row_no", "window").agg(F.count("*").alias("n"))
    shared = threes.join(F.broadcast(templates), "gram").groupBy("row_no", "window", "family", "template", "of").agg(F.count("*").alias("hits"))
    family_hits = threes.join(F.broadcast(templates.select("family", "gram").distinct()), "gram").groupBy("row_no", "window", "family").agg(F.count("*").alias("in_family"))
    whole = shared.groupBy("row_no", "window", "family").agg(F.max(F.col("hits") / F.col("of")).alias("of_template"))
    near = family_hits.join(whole, ["row_no", "window", "family"]).join(size, ["row_no", "window"]).select("row_no", "window", "family", F.greatest(F.col("in_family") / F.col("n"), "of_template").alias("contained"))
    hits = family_hits.groupBy("row_no", "window").agg(F.map_from_entries(F.collect_list(F.struct("family", "in_family"))).alias("hits"))  # at most one entry a family
    judged = predicted.join(near, ["row_no", "window", "family"], "left").join(hits, ["row_no", "window"], "left")
    contained = F.coalesce("contained", F.lit(0.0))
    confirmed = (F.col("family") > 0) & (F.col("probability") >= bound) & (contained >= CONTAINED)
    is_piece = F.col("window").bitwiseAND(F.lit(1 << 31)) != 0
    judged = stage(judged.select("row_no", "window", F.shiftright("window", 32).alias("unit"), is_piece.alias("piece"), "family", "probability", contained.alias("contained"), confirmed.alias("confirmed"), "hits").where(~F.col("piece") | F.col("confirmed")), "licences")

    families = judged.where(~F.col("piece") & F.col("confirmed")).groupBy("row_no", "unit").agg(F.collect_set("family").alias("of_unit"))
    own = F.element_at("hits", F.col("family"))
    explained = F.exists(F.coalesce("of_unit", F.array().cast("array<int>")), lambda f: F.coalesce(F.try_element_at(F.col("hits"), f), F.lit(0).cast("long")) >= CONTAINED * own)
    pieces = judged.where("piece").join(families, ["row_no", "unit"], "left").where(~explained)
    counted = judged.where(~F.col("piece")).unionByName(pieces.drop("of_unit"))
    name = F.element_at(F.array(*[F.lit(f) for f in FAMILIES]), F.col("family") + 1)
    return counted.select("row_no", "window", name.alias("family"), "probability", "contained", "confirmed")


def _spelled(n: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size("words") - (n - 1)), lambda i: F.array_join(F.slice("words", i, n), " "))


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_windows (scored), n_confirmed, n_unknown, families (sorted, distinct)."""
    scanned = scan_windows(docs, id_col, text_col)
    judged = classify(scanned).groupBy("row_no").agg(
        F.count("*").alias("n_windows"),
        F.count_if("confirmed").alias("n_confirmed"),
        F.array_sort(F.collect_set(F.when(F.col("confirmed"), F.col("family")))).alias("families"),
    )
    zero = F.lit(0).cast("long")
    found = scanned.select("row_no", "doc_id").join(judged, "row_no", "left")
    return found.select("doc_id", F.coalesce("n_windows", zero).alias("n_windows"), F.coalesce("n_confirmed", zero).alias("n_confirmed"), (F.coalesce("n_windows", zero) - F.coalesce("n_confirmed", zero)).alias("n_unknown"), F.coalesce("families", F.array().cast("array<string>")).alias("families"))
