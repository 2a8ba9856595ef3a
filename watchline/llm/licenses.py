"""Licence scans by a trained paragraph classifier, in DataFrame operations only.

A multinomial logistic regression over word n-grams (one and two words) is fitted on the driver to licence
notices of known families, cut and worded in several ways, to notices of other licences, and to ordinary text.
Its few hundred weights are a literal of the query. A temperature fitted on held-out paragraphs calibrates the
probabilities: a line that is rather a licence notice than not, but of no sure family, is of the unknown class,
and a sure one must also share its words with a notice of that family. Lines that follow each other as one
notice, as those of a notice with hard line ends do, are one paragraph.
"""

from __future__ import annotations

import json
import random
import zlib
from collections.abc import Callable
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN, NONE = "unknown", ""
#: Least probability of a family, least share of words in common with one of its notices, and greatest probability
#: that a notice is none.
SURE, ALIKE, PLAIN = 0.7, 0.6, 0.5
#: Weights that the fit keeps, the greatest ones.
KEPT_WEIGHTS = 500

#: Public licence notices and customary short forms, by family.
NOTICES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
        "This project is released under the Apache License 2.0",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
        "The MIT License (MIT)",
        "This software is licensed under the MIT license",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "Distributed under the terms of the GNU GPL version 3",
        "Released under GPLv3",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "CC-BY-4.0": [
        "Licensed under CC BY 4.0.",
        "Available under CC BY 4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Released under the 3-clause BSD license",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
        "Licensed under the Mozilla Public License Version 2.0",
    ],
    "proprietary": [
        "All rights reserved.",
        "Copyright 2020 Example Corporation. All rights reserved. Unauthorized copying of this file, via any medium, is strictly prohibited.",
        "Proprietary and confidential.",
    ],
}
#: Notices of other licences, of the unknown class.
UNLISTED = [
    "Licensed under the terms that the owner of this site gives on request.",
    "See the license for details.",
    "See the LICENSE file for license terms.",
    "Licensed under the Eclipse Public License - v 2.0",
    "This library is licensed under the Artistic License 2.0",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "This is free and unencumbered software released into the public domain.",
    "Released under the Microsoft Public License",
    "Distributed under the Common Development and Distribution License",
    "SPDX-License-Identifier: ISC",
    "SPDX-License-Identifier: EPL-2.0",
    "The text of this page is under a licence of its own.",
    "This data is made available under the Community Data License Agreement",
    "Licensed under the Python Software Foundation License version 2",
    "This work is licensed under the Creative Commons Zero public domain dedication",
    "The software is licensed, not sold, under the terms of the accompanying license agreement",
]
#: Paragraphs that are no licence notices.
OTHERS = [
    "A driving license was issued to the owner of the car in the year of the fire.",
    "The software is free and the version that was released last week is faster.",
    "Permission to enter the building was granted by the office.",
    "Copyright law protects the work of an author for many years.",
    "The public was asked to use the general entrance under the bridge.",
    "The apache helicopter landed and the gnu ran to the river.",
    "All rights and duties of the members are reserved to the assembly.",
    "This work was done under great pressure and with common means.",
    "The committee will publish the terms of the contract in its final form.",
    "You may use the following conditions to obtain a copy of the file.",
    "The license number of the dog is written on its collar.",
    "Distributed systems keep copies of their source and binary logs.",
    "Distributed under the terms of the treaty of the year.",
    "Released under the bridge and available under water.",
    "Available under certain conditions, by version 3 of the plan.",
    "The film was released under the title of the book.",
    "The use of this source of water is free.",
    "This work is the best of the year, and this is great work.",
]
WORD = r"[\p{L}\p{N}]+"


def split(text: str) -> list[str]:
    import regex

    return regex.findall(WORD, text.lower())


def grams(words: list[str]) -> list[str]:
    return sorted(set(words) | {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def paragraphs(rng: random.Random, n: int) -> tuple[list[list[str]], list[int]]:
    """Labelled paragraphs: notices and others whole, cut, and with words of ordinary text put around.

    Labels are the families' places, then those of the unknown class and of no licence.
    """
    filler = sorted({w for text in OTHERS for w in split(text)} | set("re the on anea tionet ou ver la de und que ciones".split()))
    made_up = lambda: [rng.choice("bcdfglmnprst") + rng.choice("aeiou") + rng.choice("lmnrst") + rng.choice(["", "o", "is"]) for _ in range(rng.randint(1, 2))]
    rows, labels = [], []
    for label, texts in enumerate([*NOTICES.values(), UNLISTED, OTHERS]):
        for _ in range(n if label < len(NOTICES) else 3 * n):
            w = split(rng.choice(texts))
            kind = rng.random()
            if kind < 0.3 and len(w) > 8:
                start = rng.randrange(len(w) // 3)
                w = w[start : start + rng.randint(max(6, len(w) // 2), len(w))]
            elif kind < 0.5:
                w = rng.choices(filler, k=rng.randint(1, 4)) + w
            elif kind < 0.7:
                w = w + rng.choices(filler, k=rng.randint(1, 4))
            rows.append(w)
            labels.append(label)
    for _ in range(3 * n):  # licences of made-up names, and ordinary text
        ways = ["licensed under the {} license", "released under the {} public license", "spdx license identifier {}", "this work is licensed under the {} license version 2", "distributed under the terms of the {} software license", "available under the {} license", "this software is licensed under the {} licence"]
        rows.append(rng.choice(ways).format(" ".join(made_up())).split())
        labels.append(len(NOTICES))
        rows.append(rng.choices(filler, k=rng.randint(3, 40)))
        labels.append(len(NOTICES) + 1)
    return rows, labels


@lru_cache(maxsize=1)
def classifier() -> tuple[dict[str, list[float]], list[float]]:
    """Weights by n-gram and class (families, unknown, none), and biases, divided by the temperature."""
    rng = random.Random(7)
    rows, labels = paragraphs(rng, 60)
    names = sorted({g for r in rows for g in grams(r)})
    place = {g: i for i, g in enumerate(names)}

    def matrix(listed: list[list[str]]) -> np.ndarray:
        x = np.zeros((len(listed), len(names) + 1), np.float32)
        x[:, -1] = 1
        for i, r in enumerate(listed):
            x[i, [place[g] for g in grams(r) if g in place]] = 1
        return x

    def probabilities(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    x, y = matrix(rows), np.eye(len(NOTICES) + 2, dtype=np.float32)[labels]
    w = np.zeros((x.shape[1], y.shape[1]), np.float32)
    keep = np.ones((x.shape[1], 1), np.float32)
    for part in range(2):  # the second time only the weights that are kept
        for _ in range(150):
            w -= 1.0 * keep * (x.T @ (probabilities(x @ w) - y) / len(x) + 2e-4 * w)
        if part == 0:
            size = np.abs(w[:-1]).max(1)
            keep[:-1][size < np.sort(size)[-min(KEPT_WEIGHTS, len(size))]] = 0
            w *= keep
    other_rows, other_labels = paragraphs(rng, 30)
    z = matrix(other_rows) @ w
    loss = lambda t: -np.log(probabilities(z / t)[np.arange(len(z)), other_labels] + 1e-9).mean()
    w = w / min(np.linspace(0.3, 3, 28), key=loss)
    return {g: [round(float(v), 6) for v in w[i]] for g, i in place.items() if keep[i]}, [round(float(v), 6) for v in w[-1]]


#: Lists that the kept n-grams are dealt over, by the hash of an n-gram, so that each is looked up in a short one.
BUCKETS = 2048


def weight_table() -> Column:
    """The kept n-grams ``g`` and their weights ``w`` in BUCKETS lists, as one literal."""
    buckets: list[list[dict]] = [[] for _ in range(BUCKETS)]
    for g, row in classifier()[0].items():
        buckets[zlib.crc32(g.encode()) % BUCKETS].append({"g": g, "w": row})
    return F.from_json(F.lit(json.dumps(buckets)), "array<array<struct<g:string,w:array<double>>>>")


def named(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def family_of(paragraph: Column) -> Column:
    """The confirmed family of a paragraph, or unknown, or null if it is no licence notice."""
    _, bias = classifier()
    table = weight_table()
    of = lambda g: F.filter(F.element_at(table, (F.crc32(g.cast("binary")) % BUCKETS + 1).cast("int")), lambda b: b["g"] == g)
    notices = F.array(*(F.array(*(F.array(*(F.lit(w) for w in sorted(set(split(n))))) for n in texts)) for texts in NOTICES.values()))
    families = F.array(*(F.lit(n) for n in NOTICES))

    def by_words(words: Column) -> Column:
        pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))
        return named(F.flatten(F.transform(F.array_union(words, pairs), of)), lambda found: F.when(F.size(found) > 0, by_grams(words, found)))

    def by_grams(words: Column, found: Column) -> Column:
        scores = F.aggregate(found, F.array(*(F.lit(b) for b in bias)), lambda total, row: F.zip_with(total, row["w"], lambda a, b: a + b))
        return named(scores, lambda z: by_scores(words, z))

    def by_scores(words: Column, scores: Column) -> Column:
        top = F.array_max(scores)
        total = F.aggregate(scores, F.lit(0.0), lambda t, s: t + F.exp(s - top))
        none = F.exp(F.element_at(scores, -1) - top) / total
        best = F.array_position(scores, top).cast("int")
        common = lambda notice: F.size(F.array_intersect(words, notice))
        shared = lambda notice: common(notice) / F.least(F.size(F.array_distinct(words)), F.size(notice))
        alike = F.exists(F.element_at(notices, F.least(best, F.lit(len(NOTICES)))), lambda notice: (common(notice) >= 2) & (shared(notice) >= ALIKE))
        sure = F.when(best > len(NOTICES), False).when(1 / total < SURE, False).otherwise(alike)
        return F.when(sure, F.element_at(families, F.least(best, F.lit(len(NOTICES))))).when(none < PLAIN, F.lit(UNKNOWN))

    return named(F.regexp_extract_all(F.lower(paragraph), F.lit(WORD), 0), by_words)


def joined(marked: Column) -> Column:
    """Marked lines (at, line, family) as paragraphs: a line joins the one before if both are of one family, or one
    of them is of the unknown class and the other a family's; lines of the unknown class make one paragraph."""
    empty = F.expr("cast(array() AS array<struct<at:int,line:string,family:string>>)")

    def add(done: Column, line: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        follows = (line["at"] == last["at"] + 1) & ((line["family"] == last["family"]) | (line["family"] == UNKNOWN) | (last["family"] == UNKNOWN))
        merged = F.struct(line["at"].alias("at"), F.concat_ws(" ", last["line"], line["line"]).alias("line"), F.when(last["family"] == UNKNOWN, line["family"]).otherwise(last["family"]).alias("family"))
        return F.when(F.coalesce(follows, F.lit(False)), F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(merged))).otherwise(F.concat(done, F.array(line)))

    return F.aggregate(marked, empty, add)


def licenses(docs: DataFrame) -> DataFrame:
    """``doc_id, families, n_known, n_unknown`` of each row.

    Every line of the text is classified; lines of one notice that follow each other are one paragraph, and one of
    several lines of the unknown class is classified again as a whole. ``families`` lists the confirmed families,
    sorted and comma-joined; n_known counts the paragraphs with one, n_unknown those of the unknown class. Null and
    empty texts have no paragraphs. Each row is looked at on its own; other columns are left out.
    """
    lines = F.transform(F.split("text", "\n"), lambda line, at: F.struct(at.alias("at"), line.alias("line"), family_of(line).alias("family")))
    marked = docs.select("doc_id", F.filter(lines, lambda x: x["family"].isNotNull()).alias("marked"))
    again = lambda x: F.when((x["family"] == UNKNOWN) & x["line"].contains(" "), F.coalesce(family_of(x["line"]), F.lit(UNKNOWN))).otherwise(x["family"])
    found = F.when(F.size("marked") > 0, F.transform(joined(F.col("marked")), again))
    each = marked.select("doc_id", F.coalesce(found, F.expr("cast(array() AS array<string>)")).alias("found"))
    known = F.filter("found", lambda f: f != UNKNOWN)
    return each.select(
        "doc_id",
        F.array_join(F.array_sort(F.array_distinct(known)), ",").alias("families"),
        F.size(known).cast("long").alias("n_known"),
        (F.size("found") - F.size(known)).cast("long").alias("n_unknown"),
    )
