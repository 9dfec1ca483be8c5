"""Licence scan of paragraphs with native functions only."""

from __future__ import annotations

import functools
import math
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendloom.llm.columns import named

# How public licences are called and what they say, by family: names, identifiers, sentences.
LICENCES: dict[str, tuple[tuple[str, ...], tuple[str, ...], tuple[str, ...]]] = {
    "AGPL-3.0": (
        ("GNU Affero General Public License", "GNU Affero General Public License, version 3", "Affero GPL", "AGPL", "AGPL v3", "AGPLv3"),
        ("AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later"),
        (
            "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
            "You should have received a copy of the GNU Affero General Public License along with this program.",
            "your modified version must prominently offer all users interacting with it remotely through a computer network an opportunity to receive the Corresponding Source",
        ),
    ),
    "Apache-2.0": (
        ("Apache License, Version 2.0", "Apache License 2.0", "Apache License", "Apache 2.0", "Apache Software License"),
        ("Apache-2.0", "ASL 2.0"),
        (
            "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
            "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
            "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        ),
    ),
    "BSD": (
        ("BSD License", "BSD 3-Clause License", "BSD 2-Clause License", "New BSD License", "Simplified BSD License", "Modified BSD License", "BSD"),
        ("BSD-3-Clause", "BSD-2-Clause"),
        (
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
            "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
            "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
            "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        ),
    ),
    "BSL-1.0": (
        ("Boost Software License", "Boost Software License, Version 1.0", "Boost License"),
        ("BSL-1.0",),
        (
            "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)",
            "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use, reproduce, display, distribute, execute, and transmit the Software",
        ),
    ),
    "CC-BY": (
        ("CC BY 4.0", "CC BY 3.0", "CC BY", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution 4.0", "Creative Commons Attribution License"),
        ("CC-BY-4.0", "CC-BY-3.0"),
        ("This work is licensed under a Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/",),
    ),
    "CC-BY-NC": (
        ("CC BY-NC 4.0", "CC BY-NC", "Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution-NonCommercial License", "Creative Commons NonCommercial"),
        ("CC-BY-NC-4.0", "CC-BY-NC-3.0"),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License. To view a copy visit http://creativecommons.org/licenses/by-nc/4.0/",),
    ),
    "CC-BY-SA": (
        ("CC BY-SA 4.0", "CC BY-SA", "Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike License", "Creative Commons Attribution ShareAlike"),
        ("CC-BY-SA-4.0", "CC-BY-SA-3.0"),
        ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License. To view a copy visit http://creativecommons.org/licenses/by-sa/4.0/",),
    ),
    "CC0-1.0": (
        ("CC0", "CC0 1.0 Universal", "Creative Commons Zero", "CC0 Public Domain Dedication"),
        ("CC0-1.0",),
        (
            "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
            "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law",
        ),
    ),
    "EPL": (
        ("Eclipse Public License", "Eclipse Public License 2.0", "Eclipse Public License v 1.0", "Eclipse License", "EPL v2"),
        ("EPL-2.0", "EPL-1.0"),
        (
            "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
            "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0",
        ),
    ),
    "GPL-2.0": (
        ("GNU General Public License, version 2", "GNU General Public License version 2", "GNU GPL v2", "GPL version 2", "GPL v2", "GPLv2"),
        ("GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later"),
        (
            "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
            "it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
        ),
    ),
    "GPL-3.0": (
        ("GNU General Public License, version 3", "GNU General Public License version 3", "GNU General Public License", "GNU GPL v3", "GNU GPL", "GPL version 3", "GPL v3", "GPLv3", "GPL"),
        ("GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later"),
        (
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
            "You should have received a copy of the GNU General Public License along with this program. If not, see http://www.gnu.org/licenses/",
        ),
    ),
    "ISC": (
        ("ISC License", "ISC"),
        ("ISC",),
        (
            "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
            "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
        ),
    ),
    "LGPL": (
        ("GNU Lesser General Public License", "GNU Library General Public License", "GNU LGPL", "LGPL", "LGPL v2.1", "LGPLv3", "Lesser GPL"),
        ("LGPL-2.1", "LGPL-2.1-or-later", "LGPL-3.0"),
        (
            "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
            "You should have received a copy of the GNU Lesser General Public License along with this library",
        ),
    ),
    "MIT": (
        ("MIT License", "MIT licence", "MIT", "Expat License", "X11 License"),
        ("MIT",),
        (
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
            "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
            "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
            "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE",
        ),
    ),
    "MPL-2.0": (
        ("Mozilla Public License", "Mozilla Public License, v. 2.0", "Mozilla Public License 2.0", "MPL", "MPL 2.0"),
        ("MPL-2.0", "MPL-1.1"),
        ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",),
    ),
    "Unlicense": (
        ("The Unlicense", "Unlicense"),
        ("Unlicense",),
        (
            "This is free and unencumbered software released into the public domain.",
            "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        ),
    ),
}

# Frames in which a name (or identifier) stands; the regressions are fitted on the first list, calibrated on the second.
FRAMES = (
    ("{}", "Released under the {}.", "Licensed under {}.", "This project is licensed under the terms of the {} license.", "This work is licensed under the {}.", "({})", "Distributed under the {}, see LICENSE for details", "The code is available under {}", "SPDX-License-Identifier: {}", "License: {}", "Published under {}-style license"),
    ("Made available under the {}.", "This file is covered by the {}", "You may use it under the {}", "Copyright 2020 the authors, {}", "all content is released under {} unless otherwise noted", "license = {}"),
)

# Sentences that speak of licences or use their words without stating one; every third one calibrates.
UNKNOWN = (
    "The driver must carry a license for the car at all times.",
    "Her license to practise medicine was renewed under the new rules.",
    "The terms of the agreement were published in version 2 of the report.",
    "All rights reserved by the public library and its software department.",
    "The general public may visit the foundation free of charge.",
    "We released the work in source and binary form last year.",
    "Under the terms of the work permit you may not use this file.",
    "A copy of the creative work is at the library.",
    "This work is a copy of the program of the festival.",
    "The commons were open to the public in all seasons.",
    "Please license the photographs before you print them.",
    "The software was sold without warranty.",
    "Die Kinder gingen mit der Mutter nach Hause und kamen mit dem Vater wieder.",
    "Er arbeitet mit einer Software für den Verkauf.",
    "The museum keeps a copyright notice on every photograph.",
    "Permission to enter the building is granted by the guard.",
    "The new version of the program was distributed to all schools.",
    "An eclipse of the sun was seen by the public last week.",
    "The affero, a small bird, is at home in the hills.",
    "They gave the boost that the economy needed, said the report.",
    "The Apache people lived in the south west.",
    "The authors are not liable for damages, the court said.",
    "Anyone is free to come and use the garden for any purpose.",
    "The president was granted permission without fee or conditions.",
    "Redistribution of income is the subject of this book.",
    "The contract was modified and the copies were sold to the foundation.",
    "Under the new law a license is needed for commercial fishing.",
    "The lesser known works of the painter are in the general collection.",
    "She made the files available on the network for all users.",
    "Attribution of the painting is not certain, international experts say.",
    "Mozilla and other firms sent people to the meeting.",
    "To the extent possible the work will be done in the open.",
    "The universal rights of man were published in the library.",
    "The source of the river is in the public forest.",
    "The license was not renewed, and the shop closed.",
    "A clause in the contract says that the merchant is not limited.",
    "mit Freude", "Tee mit Milch",
    "mit der Zeit wird alles gut", "Sie fuhr mit ihrem Bruder in die Stadt.",
    "spricht mit", "mit uns",
    "Ein Haus mit Garten", "kommt mit",
    "The attention of the general public", "A total eclipse",
    "Er kommt mit dem Bus", "Wir gehen mit den Kindern", "Das Kind spielt mit dem Ball",
    "Sie schreibt mit einem Stift", "mit Blick auf das Meer", "Brot mit Butter und Salz",
    "Er sprach lange mit seinem Lehrer", "zusammen mit anderen", "mit großer Mühe",
    "Die Stadt wuchs mit der Zeit", "mit dem Zug", "Kaffee mit Zucker",
    "Der Mann mit dem Hut", "nicht mit mir", "mit allen Mitteln",
)

# Words that say nothing of a licence, alone or with each other.
COMMON = frozenset(
    "a about above after again all also an and any are as at be been before but by can could do each either for from had has have he her his how i if in into is it its last made make may more most must "
    "new no not of on one or other our out over said same see should so some such than that the their them then there these they this those through to two under until up only use used was we were what "
    "when where which who will with would year you your der die das und den dem ein eine für nicht von zu ist la le les de des et un une en el los las y que del".split()
)

#: Words are runs of letters and digits of the lower-cased paragraph.
WORD = r"[a-z0-9]+"
#: A paragraph is scored in windows of so many words, half overlapping.
WINDOW = 32
#: In a paragraph of so many words, one telling word may state a licence.
SHORT = 8
#: The least chance at which a licence counts as stated.
CERTAINTY = 0.6


def words_of(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


def grams_of(words: list[str]) -> list[str]:
    """Single words and pairs of neighbours."""
    return [*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))]


def telling(gram: str) -> bool:
    """Whether an n-gram has a word that is not common nor a mere number."""
    return any(w not in COMMON and not w.isdigit() for w in gram.split(" "))


def windows_of(words: list[str]) -> list[list[str]]:
    return [words[k : k + WINDOW] for k in range(0, max(1, len(words) - WINDOW // 2), WINDOW // 2)]


@dataclass(frozen=True)
class Model:
    """Sparse one-against-rest logistic regressions: weights[n-gram][family], biases, slope and offset of the
    calibration, the words without one of which no paragraph scores above the biases, those of them that don't tell alone
    among more than SHORT words, and the templates by family."""

    families: tuple[str, ...]
    weights: dict[str, tuple[float, ...]]
    bias: tuple[float, ...]
    slope: float
    offset: float
    anchors: tuple[str, ...]
    weak: tuple[str, ...]
    templates: dict[str, tuple[str, ...]]


def train(licences: dict[str, tuple[tuple[str, ...], tuple[str, ...], tuple[str, ...]]] = LICENCES, frames: tuple[tuple[str, ...], tuple[str, ...]] = FRAMES, unknown: tuple[str, ...] = UNKNOWN, rounds: int = 200, l1: float = 2e-4) -> Model:
    """Fits the regressions on names in frames, on sentences and their halves, and on sentences of no licence; texts of
    fixed number.

    An example is the set of its n-grams scaled to length one, also with room for words around it, as in a longer
    window. Only n-grams with a telling word are features, so a paragraph without such a word can't reach a family.
    The best score is calibrated (Platt's logistic fit of "some licence" against "unknown") on frames, parts of
    sentences and unknown sentences that the regressions are not fitted on.
    """
    families = tuple(sorted(licences))
    fitted: list[tuple[list[str], int]] = []
    held: list[tuple[list[str], int]] = []
    for k, family in enumerate(families):
        names, identifiers, sentences = licences[family]
        for n, name in enumerate([*names, *identifiers]):
            fitted += [(words_of(f.format(name)), k) for j, f in enumerate(frames[0]) if n < 3 or j < 3 or (n + j) % 2]
            held += [(words_of(f.format(name)), k) for j, f in enumerate(frames[1]) if (n + j) % 2]
        for text in sentences:
            w = words_of(text)
            fitted += [(x, k) for x in windows_of(w)]
            if len(w) > 12:
                fitted.append((w[: len(w) // 2 + 2], k))
                held += [(w[len(w) // 2 - 2 :], k), (w[2:-2], k)]
    for n, text in enumerate(unknown):
        (held if n % 3 == 2 else fitted).append((words_of(text), -1))
    # frames without a name say nothing, nor do single words of names and sentences, but for names of one word
    fitted += [(words_of(f.format(x)), -1) for f in frames[0] for x in ("", "festival", "new terms")]
    held += [(words_of(f.format(x)), -1) for f in frames[1] for x in ("", "library")]
    alone = {x[0] for names, ids, _ in licences.values() for x in map(words_of, [*names, *ids]) if len(x) == 1}
    fitted += [([w] * n, -1) for w in sorted({w for ws, k in fitted if k >= 0 for w in ws if telling(w)} - alone) for n in (1, 2)]
    fitted += [(words_of(x), -1) for x in ("general public", "free software", "software license", "public license", "public library", "creative works", "source code")]
    place = {g: k for k, g in enumerate(sorted({g for w, k in fitted if k >= 0 for g in grams_of(w) if telling(g)}))}
    room = (0, 40)

    def matrix(rows: list[tuple[list[str], int]]) -> tuple[np.ndarray, np.ndarray]:
        x = np.zeros((len(rows) * len(room), len(place)), np.float32)
        for i, (words, _) in enumerate(rows):
            grams = set(grams_of(words))
            at = [place[g] for g in grams if g in place]
            for j, more in enumerate(room):
                x[i * len(room) + j, at] = 1 / math.sqrt(max(1, len(grams) + more))
        return x, np.repeat([k for _, k in rows], len(room))

    x, y = matrix(fitted)
    hot = (y[:, None] == np.arange(len(families))).astype(np.float32)
    each = np.where(hot > 0, 0.5 * len(x) / np.maximum(1, hot.sum(0)) / 2, 1).astype(np.float32)
    weight, bias = np.zeros((len(place), len(families)), np.float32), np.full(len(families), -2.0, np.float32)
    m, v = np.zeros_like(weight), np.zeros_like(weight)
    for step in range(1, rounds + 1):
        d = (1 / (1 + np.exp(-np.clip(x @ weight + bias, -30, 30))) - hot) * each / len(x)
        g = x.T @ d
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        weight -= 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
        weight = np.sign(weight) * np.maximum(0, np.abs(weight) - l1 * 10)
        bias = np.minimum(-1.0, bias - 2 * d.sum(0))
    kept = np.flatnonzero((np.abs(weight) > 0.05).any(axis=1))
    names = sorted(place, key=place.get)
    weights = {names[k]: tuple(round(float(z), 3) for z in weight[k]) for k in kept}
    hx, hy = matrix(held)
    small = np.zeros_like(weight)
    small[kept] = weight[kept]
    best = (hx @ small + bias).max(axis=1).astype(np.float64)
    some = (hy >= 0).astype(np.float64)
    share = np.where(some > 0, 0.5 / some.sum(), 0.5 / max(1.0, (1 - some).sum()))
    slope, offset = 1.0, 0.0
    for _ in range(3000):
        d = (1 / (1 + np.exp(-np.clip(slope * best + offset, -30, 30))) - some) * share
        slope, offset = slope - 0.2 * float(d @ best), offset - 0.2 * float(d.sum())
    rising = [g for g, row in weights.items() if max(row) > 0]
    anchors = tuple(sorted({w for g in rising for w in g.split(" ") if telling(w)}))
    # what a word can add up to with common words beside it, over the n-grams of more than SHORT words
    def reach(word: str) -> float:
        alone = np.maximum(0, weights.get(word, np.zeros(len(families))))
        beside = [np.maximum(0, weights[g]) for g in rising if " " in g and word in g.split(" ") and all(w == word or not telling(w) for w in g.split(" "))]
        return float(((alone + np.sort(beside, axis=0)[-2:].sum(axis=0) if beside else alone) / math.sqrt(2 * SHORT + 1) + bias).max())

    weak = tuple(a for a in anchors if 1 / (1 + math.exp(-(slope * reach(a) + offset))) < CERTAINTY)
    templates = {f: tuple([*ns, *ids, *ts]) for f, (ns, ids, ts) in licences.items()}
    return Model(families, weights, tuple(round(float(b), 3) for b in bias), round(slope, 4), round(offset, 4), anchors, weak, templates)


@functools.lru_cache(maxsize=1)
def default_model() -> Model:
    return train()


def scan_licences(docs: DataFrame, model: Model | None = None, text: str = "text", doc_id: str = "doc_id", certainty: float = CERTAINTY, agreement: float = 0.6) -> DataFrame:
    """One row per paragraph that speaks of licences: doc_id, paragraph, start, family, probability, template, agreement,
    confirmed.

    A paragraph is a line; a line that ends without a full stop goes on in the next one, as wrapped text does. It is
    scored in half overlapping windows of WINDOW words, and its best window counts, so a statement inside a long
    paragraph is not diluted. A window's n-grams are looked up in the model's weights; family is the best-scoring one,
    probability the calibrated chance that a licence is stated, and family is 'unknown' where that is under
    ``certainty``. A known family is then compared with its templates: agreement is the largest share of a template's
    n-grams that the window has, and confirmed says whether it reaches ``agreement``.

    Paragraphs are scored and listed if they have an anchor, or, of more than SHORT words, one that is not weak or two
    different ones. The anchors are all telling words of n-grams with a positive weight, so a paragraph without any
    scores no more than the biases; a weak one alone, with common words beside it, can't lift so many words to
    CERTAINTY. So the others are unknown without being scored.

    start is the character at which the paragraph begins. A null or empty text has no paragraphs and gives no rows;
    repeated rows are scanned each; a null doc_id stays null; an empty table gives no rows. A paragraph of any length
    is read whole. Only functions of Spark are used; the model is a fixed table of weights.
    """
    model = model or default_model()
    if certainty < CERTAINTY or 1 / (1 + math.exp(-(model.slope * max(model.bias) + model.offset))) >= certainty:
        raise ValueError(f"paragraphs that are not scored could be known; certainty is at least {CERTAINTY}")
    rows = docs.select(named(doc_id).alias("doc_id"), named(text).alias("text"))
    anchor = rf"(?<![a-z0-9])(?:{'|'.join(model.anchors)})(?![a-z0-9])"
    joined = F.regexp_replace("text", r"(?<=[^.!?:;\s])\n(?=\S)", " ")
    rows = rows.where(F.lower("text").rlike(anchor)).select("doc_id", F.split(joined, "\n").alias("all"))
    # a paragraph goes on with its own start only, never with the others
    placed = F.zip_with("all", _starts(F.transform("all", lambda x: F.char_length(x).cast("long") + 1)), lambda x, s: F.struct(x.alias("line"), s.alias("start")))
    lines = rows.select("doc_id", F.posexplode(placed).alias("paragraph", "p")).select("doc_id", "paragraph", "p.line", "p.start")
    lines = lines.where(F.lower("line").rlike(anchor)).withColumn("words", F.regexp_extract_all(F.lower("line"), F.lit(WORD), F.lit(0)))
    found = F.array_intersect("words", F.split(F.lit(" ".join(model.anchors)), " "))
    strong = F.split(F.lit(" ".join(w for w in model.anchors if w not in model.weak)), " ")
    lines = lines.withColumn("found", F.when(F.size("words") > SHORT, found)).where(F.col("found").isNull() | (F.size("found") > 1) | F.arrays_overlap("found", strong))
    lines = lines.select("doc_id", "paragraph", "start", "words")
    last = F.greatest(F.lit(0), F.size("words") - WINDOW // 2 - 1)
    windows = F.transform(F.sequence(F.lit(0), last, F.lit(WINDOW // 2)), lambda k: F.slice(F.col("words"), k + 1, F.lit(WINDOW)))
    # tables as one literal each, which Spark turns into constants
    words_list = lambda words: F.split(F.lit("\n".join(words)), "\n")
    keys = words_list(sorted(model.weights))
    # the few n-grams of the paragraph that have weights are found once for all windows
    lines = lines.select("doc_id", "paragraph", "start", F.transform(windows, _grams).alias("windows"), F.array_intersect(_grams(F.col("words")), keys).alias("known"))
    flat = F.split(F.lit(" ".join(str(x) for g in sorted(model.weights) for x in model.weights[g])), " ").cast("array<double>")
    size = len(model.families)
    weights = lambda g: F.slice(flat, ((F.array_position(keys, g) - 1) * size + 1).cast("int"), F.lit(size))
    zero = F.array_repeat(F.lit(0.0), len(model.families))
    bias = F.array(*(F.lit(b) for b in model.bias))
    names = F.array(*(F.lit(x) for x in model.families))

    def scored(grams: Column) -> Column:
        hits = F.transform(F.array_intersect(grams, F.col("known")), weights)
        total = F.aggregate(hits, zero, lambda s, w: F.zip_with(s, w, lambda a, b: a + b))
        scores = F.zip_with(total, bias, lambda t, b: t / F.sqrt(F.greatest(F.size(grams), F.lit(1)).cast("double")) + b)
        return F.struct(F.array_max(scores).alias("best"), scores.alias("scores"), grams.alias("grams"))

    # of equal scores the first window
    lines = lines.withColumn("w", F.explode(F.slice(F.array_sort(F.transform("windows", scored), lambda a, b: F.when(a["best"] > b["best"], -1).when(a["best"] < b["best"], 1).otherwise(0)), 1, 1)))
    lines = lines.select("doc_id", "paragraph", "start", "w.*")
    lines = lines.withColumn("guess", F.element_at(names, F.array_position("scores", F.col("best")).cast("int")))
    lines = lines.withColumn("probability", 1 / (1 + F.exp(-(F.lit(model.slope) * F.col("best") + F.lit(model.offset)))))
    shares = []
    for family in model.families:
        for k, t in enumerate(model.templates[family]):
            grams = words_list(sorted(set(grams_of(words_of(t)[:WINDOW]))))
            shares.append(F.when(F.col("guess") == family, F.struct((F.size(F.array_intersect(grams, "grams")) / F.size(grams)).alias("share"), F.lit(f"{family}/{k}").alias("template"))))
    known = F.col("probability") >= certainty
    lines = lines.withColumn("match", F.when(known, F.array_max(F.array(*shares))))
    return lines.select(
        "doc_id", F.col("paragraph").cast("int").alias("paragraph"), "start",
        F.when(known, F.col("guess")).otherwise(F.lit("unknown")).alias("family"), "probability",
        F.col("match.template").alias("template"), F.col("match.share").alias("agreement"),
        F.coalesce(known & (F.col("match.share") >= agreement), F.lit(False)).alias("confirmed"),
    )


def _starts(sizes: Column, block: int = 256) -> Column:
    """Where each piece begins, from the pieces' sizes (longs): sums run within blocks and over the blocks' totals, so
    that the work hardly grows faster than the pieces."""
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / block).cast("int")), lambda k: F.slice(sizes, k * block + 1, F.lit(block)))
    running = lambda first, xs: F.aggregate(xs, F.array(first), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + x)))
    totals = F.transform(parts, lambda p: F.aggregate(p, F.lit(0).cast("long"), lambda s, x: s + x))
    offsets = running(F.lit(0).cast("long"), totals)
    # the last element of each, and the last offset, are where the next one would begin
    each = F.zip_with(parts, F.slice(offsets, F.lit(1), F.size(offsets) - 1), lambda p, o: F.slice(running(o, p), F.lit(1), F.size(p)))
    return F.flatten(each)


def _grams(words: Column) -> Column:
    """Distinct words and pairs of neighbours of a window."""
    fewer = F.greatest(F.size(words) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(words, F.lit(1), fewer), F.slice(words, F.lit(2), fewer), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.concat(words, pairs))
