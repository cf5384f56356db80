"""Licence scans by a trained paragraph classifier (operator 3).

A multinomial logistic regression over sparse word n-grams tells licence
families and an unknown class apart. It is trained here on templates with
random variations and on ordinary paragraphs; a temperature fitted on rows held
back calibrates its probabilities. A prediction counts only if the paragraph
also resembles a template of the predicted family.
"""

from __future__ import annotations

import functools
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.common import table

WORD = re.compile(r"[a-z0-9]+(?:[.+\-][a-z0-9]+)*")
UNKNOWN = "unknown"
#: Least probability and least share of a template's n-grams for a finding.
PROBABILITY, SIMILARITY = 0.5, 0.6
#: Blocks of more lines are also scanned by overlapping runs of so many lines.
RUN = 40
COMMON = frozenset("a an the of to in on at by for and or as is are was be been it its this that with from not no any all you your we our i he she they them his her which who".split())

#: Names under which the families go in notices.
NAMES = {
    "MIT": ["MIT License", "MIT licence", "Expat License", "MIT"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0", "Apache 2.0 license"],
    "GPL": ["GNU General Public License, version 3", "GNU General Public License, version 2", "GNU General Public License", "GPL-3.0", "GPL-2.0", "GNU GPL v3", "GPLv2"],
    "LGPL": ["GNU Lesser General Public License, version 3", "GNU Lesser General Public License", "LGPL-2.1", "LGPL-3.0"],
    "AGPL": ["GNU Affero General Public License, version 3", "GNU Affero General Public License", "AGPL-3.0"],
    "BSD": ["BSD 3-Clause License", "BSD 2-Clause License", "BSD-3-Clause", "BSD-2-Clause", "BSD license", "New BSD License"],
    "MPL-2.0": ["Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "MPL-2.0", "MPL 2.0"],
    "ISC": ["ISC License", "ISC licence"],
    "EPL-2.0": ["Eclipse Public License 2.0", "Eclipse Public License, version 2.0", "EPL-2.0"],
    "BSL-1.0": ["Boost Software License, Version 1.0", "Boost Software License", "BSL-1.0"],
    "CC0-1.0": ["CC0 1.0 Universal", "CC0", "CC0-1.0", "Creative Commons Zero"],
    "CC-BY": ["CC BY 4.0", "CC-BY-4.0", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution License", "CC BY 3.0"],
    "CC-BY-SA": ["CC BY-SA 4.0", "CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 3.0"],
    "CC-BY-NC": ["CC BY-NC 4.0", "CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC-SA 4.0"],
    "Unlicense": ["Unlicense", "The Unlicense"],
    "EUPL-1.2": ["European Union Public Licence 1.2", "European Union Public Licence, version 1.2", "EUPL-1.2", "EUPL v1.2"],
}
NOTICES = ["Released under the {}.", "Licensed under the {}.", "Licensed under {}.", "This work is licensed under the {}.", "This work is licensed under {}.", "This project is licensed under the terms of the {}.", "SPDX-License-Identifier: {}", "Distributed under the {}, see the LICENSE file.", "This software is available under the {}.", "License: {}", "You may use this text under the {}."]

#: Telling paragraphs of the licences' public texts.
TEXTS = {
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "GPL": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "LGPL": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "AGPL": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "BSL-1.0": ["Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software"],
    "CC0-1.0": ["The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law."],
    "CC-BY-SA": ["If you remix, transform, or build upon the material, you must distribute your contributions under the same license as the original."],
    "CC-BY-NC": ["You may not use the material for commercial purposes."],
    "Unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
}
#: Paragraphs that talk of rights or licences without granting one.
DECOYS = [
    "All rights reserved. No part of this publication may be reproduced without permission of the publisher.",
    "By using this website you agree to our terms of service and privacy policy.",
    "Copyright 2020 the authors.",
    "The driver must carry a valid driving license at all times.",
    "The city council voted to grant a licence to the new restaurant on the main street.",
    "Permission to enter the building was granted by the head of security.",
    "The software is distributed in two versions, one for students and one for general use.",
    "A university licensed the patent to a company for a fee.",
    "The general public is invited to the opening of the library.",
    "He took a course at MIT and moved to Boston with the source of his ideas.",
    "The Apache helicopter flew over the mountains in the second version of the story.",
    "Mozilla and Eclipse released new software to the public this year.",
    "Creative people share common ideas in public and give each other attribution.",
    "See the file for the conditions and the warranty of the product.",
]


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def grams_of(words: list[str]) -> set[str]:
    """Words, pairs and triples, without those of common words alone."""
    out = {w for w in words if w not in COMMON}
    for n in (2, 3):
        out.update(" ".join(g) for g in zip(*(words[i:] for i in range(n))) if not COMMON.issuperset(g))
    return out


def templates() -> list[tuple[str, str]]:
    return [(f, n.format(x)) for f, names in NAMES.items() for x in names for n in NOTICES] + [(f, t) for f, texts in TEXTS.items() for t in texts]


def varied(text: str, rng: random.Random) -> str:
    """The text with a lead or tail, lost words or other case."""
    words = text.split()
    if len(words) > 12 and rng.random() < 0.5:
        a = rng.randrange(len(words) // 3)
        words = words[a : a + max(10, int(len(words) * rng.uniform(0.6, 1.0)))]
    words = [w for w in words if rng.random() > 0.03 or len(words) < 6]
    if rng.random() < 0.3:
        words = rng.choice(["Copyright (c) 2019 Jane Doe.", "Note:", "Legal notice.", "//", "* "]).split() + words
    if rng.random() < 0.3:
        words += rng.choice(["See LICENSE for details.", "All rights reserved.", "Thanks to everyone."]).split()
    return " ".join(words)


class Classifier:
    """Gram weights by family; unknown is the class without weights of its own."""

    def __init__(self, ordinary: tuple[str, ...] = (), seed: int = 3, rounds: int = 150):
        rng = random.Random(seed)
        rows = [(f, varied(t, rng)) for f, t in templates() for _ in range(40 if len(t) > 120 or t in sum(TEXTS.values(), []) else 2)] + templates()
        clear = [p for p in ordinary if not {"license", "licence", "licensed", "copyright", "permission", "gnu"} & set(words_of(p))]
        shuffled = []
        for _, t in templates()[:: max(1, len(templates()) // 150)]:
            w = t.split()
            rng.shuffle(w)
            shuffled.append(" ".join(w[: max(2, len(w) // 2)]))
        rows += [(UNKNOWN, varied(t, rng)) for t in DECOYS for _ in range(12)] + [(UNKNOWN, t) for t in clear] + [(UNKNOWN, t) for t in shuffled]
        rng.shuffle(rows)
        self.families = [UNKNOWN, *sorted(NAMES)]
        held, learn = rows[::5], [r for i, r in enumerate(rows) if i % 5]
        counts: dict[str, int] = {}
        for f, t in learn:
            if f != UNKNOWN or t in DECOYS:
                for g in grams_of(words_of(t)):
                    counts[g] = counts.get(g, 0) + 1
        self.index = {g: i for i, g in enumerate(sorted(g for g, n in counts.items() if n >= 3))}
        x, y = self.matrix([t for _, t in learn]), np.array([self.families.index(f) for f, _ in learn])
        k = len(self.families)
        w, b = np.zeros((len(self.index), k), np.float32), np.zeros(k, np.float32)
        b[0] = 1.0
        target = np.eye(k, dtype=np.float32)[y]
        for _ in range(rounds):
            p = softmax(x @ w + b)
            d = (p - target) / len(x)
            w -= 8.0 * (x.T @ d + 1e-5 * w)
            b -= 2.0 * d.sum(0)
        self.weights, self.bias = w, b
        self.temperature = self.fit_temperature(self.matrix([t for _, t in held]), np.array([self.families.index(f) for f, _ in held]))
        self.vocabulary = frozenset(g for g in self.index if " " not in g)
        self.grams = [(f, frozenset(grams_of(words_of(t)))) for f, t in templates()]

    def matrix(self, texts) -> np.ndarray:
        out = np.zeros((len(texts), len(self.index)), np.float32)
        for i, t in enumerate(texts):
            found = [self.index[g] for g in grams_of(words_of(t)) if g in self.index]
            if found:
                out[i, found] = 1.0 / len(found) ** 0.5
        return out

    def fit_temperature(self, x, y) -> float:
        z = x @ self.weights + self.bias
        loss = lambda t: -np.log(softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean()
        return float(min(np.geomspace(0.3, 3, 25), key=loss))

    def __call__(self, paragraph: str) -> tuple[str, float, float] | None:
        """(family, probability, similarity) of a licence paragraph, else None."""
        words = words_of(paragraph)
        if self.vocabulary.isdisjoint(words):
            return None
        grams = grams_of(words)
        found = [self.index[g] for g in grams if g in self.index]
        z = self.bias + self.weights[found].sum(0) / len(found) ** 0.5
        p = softmax((z / self.temperature)[None])[0]
        best = int(p.argmax())
        if best == 0 or p[best] < PROBABILITY:
            return None
        family = self.families[best]
        return family, float(p[best]), max((len(grams & t) / len(t) for f, t in self.grams if f == family), default=0.0)


def softmax(z):
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


@functools.lru_cache(maxsize=2)
def trained(ordinary: tuple[str, ...]) -> Classifier:
    return Classifier(ordinary)


def blocks(text: str):
    """The (start, end) of the lines of each block between blank lines."""
    at, lines = 0, []
    for line in text.split("\n"):
        if line.strip():
            lines.append((at, at + len(line)))
        elif lines:
            yield lines
            lines = []
        at += len(line) + 1
    if lines:
        yield lines


def stretches(start: int, end: int):
    """Overlapping runs of up to RUN lines that cover start to end, then the
    whole where there are several."""
    if end - start > RUN:
        for a in range(start, end - RUN // 2, RUN // 2):
            yield a, min(a + RUN, end)
    yield start, end


def paragraphs(text: str):
    """(start, end) of lines, and of blocks of several lines between blank ones."""
    for lines in blocks(text):
        yield from lines
        if len(lines) > 1:
            yield lines[0][0], lines[-1][1]


def find(text: str, model: Classifier, similarity: float = SIMILARITY) -> list[dict]:
    """The findings of a text: single lines, then of each block the runs of
    lines that hold none of them. A run around a finding of its own family says
    nothing new."""
    found = []

    def judge(a, z):
        hit = model(text[a:z])
        if not hit or hit[2] < similarity or any(f["family"] == hit[0] and f["start"] < z and a < f["end"] for f in found[before:]):
            return False
        found.append({"start": a, "end": z, "family": hit[0], "probability": hit[1], "similarity": hit[2]})
        return True

    for lines in blocks(text):
        before = len(found)
        told = [i for i, (a, z) in enumerate(lines) if judge(a, z)]
        for last, following in zip([-1, *told], [*told, len(lines)]):
            if following - last > 2:
                for i, j in stretches(last + 1, following):
                    judge(lines[i][0], lines[j - 1][1])
    return sorted(found, key=lambda f: (f["start"], f["end"]))


def ordinary_paragraphs(docs: DataFrame, text_col: str = "text", rows: int = 400, chars: int = 1000) -> tuple[str, ...]:
    """First lines of about ``rows`` documents (no more), spread by their texts'
    hashes: what the unknown class is trained on besides the decoys. Documents
    with a first line of more than ``chars`` characters are no part of it."""
    every = docs.count() // rows + 1
    h = F.xxhash64(F.lit(17), text_col)
    found = docs.filter(F.col(text_col).isNotNull() & (F.pmod(h, F.lit(every)) == 0)).select(F.substring_index(F.col(text_col), "\n", 1).alias("p"), h.alias("h")).filter(F.char_length("p") <= chars)
    return tuple(sorted(r.p for r in found.orderBy("h", "p").limit(rows).collect()))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ordinary: tuple[str, ...] = (), similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, findings (start, end, family, probability, similarity) for every
    row of docs; offsets are characters of the whole text.

    Cases: a null, empty or blank text has no findings. Rows that share an id,
    or have none, are scanned one by one. Repeated paragraphs are each reported.
    An empty table gives no rows; other columns of docs are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    ids = dict(rows.dtypes)["doc_id"]
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("family", pa.string()), ("probability", pa.float64()), ("similarity", pa.float64())]))

    model = trained(ordinary)  # on the driver; a few hundred KB

    def run(batches):
        for batch in batches:
            out = []
            for text in batch.column(1):
                out.append(find(text.as_py() or "", model, similarity))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], ["doc_id", "findings"])

    return rows.mapInArrow(run, f"doc_id {ids}, findings array<struct<start:bigint,end:bigint,family:string,probability:double,similarity:double>>")


def op3_licenses(spark, sf_dir):
    """Licence families of ``documents``: every family found, the most probable
    finding, and how many there are."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    best = F.array_max(F.transform("findings", lambda f: F.struct(f["probability"].alias("p"), f["similarity"].alias("s"), f["family"].alias("f"))))
    return scan(docs, ordinary=ordinary_paragraphs(docs)).select(
        "doc_id", F.coalesce(best["f"], F.lit(UNKNOWN)).alias("family"), F.round(best["p"], 6).alias("probability"), F.round(best["s"], 6).alias("similarity"), F.array_join(F.array_sort(F.array_distinct("findings.family")), ",").alias("families"), F.size("findings").cast("long").alias("n_findings")
    )
