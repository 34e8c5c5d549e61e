"""Licence scans: a trained classifier of paragraphs, calibrated, with comparison to templates; DataFrame operations alone."""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Notices and opening clauses of public licences by family.
TEMPLATES: dict[str, list[str]] = {
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT license. See LICENSE in the project root for license information.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
        "Released under the GNU GPL version 2 or any later version.",
    ],
    "lgpl": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"],
    "agpl": ["Licensed under the GNU Affero General Public License, version 3."],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Released under the BSD 3-Clause License.",
    ],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc0": ["Released under CC0 1.0 Universal Public Domain Dedication.", "To the extent possible under law, the author has waived all copyright and related rights to this work."],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
    "proprietary": ["All rights reserved.", "All rights reserved. No part of this publication may be reproduced without prior written permission.", "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited."],
}

#: Paragraphs that speak of licences, rights and the like without granting any.
OTHERS = [
    "He lost his driving license and had to apply for a new license at the office.",
    "The bar was refused a liquor license by the town.",
    "The restaurant's license number is shown at the door.",
    "Copyright law differs between countries and changes often.",
    "You need permission from the school to enter the building.",
    "The public library is free and open on Sunday.",
    "Apache helicopters flew over the base.",
    "The software comes with a warranty of two years.",
    "The company sells licenses for its software to banks.",
    "She studied at MIT and works in Boston.",
    "The terms of the agreement are subject to change.",
    "The new version is distributed to all offices.",
]

#: A feature must hold one of these word beginnings; a paragraph without any has no feature.
ANCHORS = "licen copyright permission redistribut warrant apache gnu gpl mit bsd mozilla creative attribution cc cc0 public proprietary unencumbered rights reproduced".split()

BUCKETS = 4096
FAMILIES = [*TEMPLATES, "unknown"]
_WORD = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
_ANCHORED = "(?:^|[^a-z0-9.-])(?:" + "|".join(ANCHORS) + ")"


def words_of(text: str) -> list[str]:
    low = "".join(LOWER[UPPER.index(c)] if c in UPPER else c for c in text)
    return re.findall(_WORD, low)


def ngrams_of(words: list[str]) -> list[str]:
    grams = [*words, *(" ".join(p) for p in zip(words, words[1:], strict=False)), *(" ".join(p) for p in zip(words, words[1:], words[2:], strict=False))]
    return sorted({g for g in grams if any(w.startswith(a) for w in g.split(" ") for a in ANCHORS)})


class Model:
    """Multinomial logistic regression over hashed n-grams; weights[bucket, family] and a bias, with a temperature."""

    def __init__(self, hash_of, rounds: int = 400, rate: float = 2.0, ridge: float = 1e-3):
        texts, labels = [], []
        for k, family in enumerate(FAMILIES[:-1]):
            for t in TEMPLATES[family]:
                w = words_of(t)
                texts += [w, w[: max(4, 2 * len(w) // 3)], w[len(w) // 3 :]]
                labels += [k, k, k]
        for t in OTHERS:
            texts.append(words_of(t))
            labels.append(len(FAMILIES) - 1)
        texts += [[a] for a in ANCHORS]
        labels += [len(FAMILIES) - 1] * len(ANCHORS)
        grams = [ngrams_of(w) for w in texts]
        place = hash_of(sorted({g for x in grams for g in x}))
        x = np.zeros((len(texts), BUCKETS))
        for r, gs in enumerate(grams):
            x[r, [place[g] for g in gs]] = 1
        y = np.eye(len(FAMILIES))[labels]
        weight = (y / y.sum(axis=0)).sum(axis=1, keepdims=True)
        used = np.flatnonzero(x.any(axis=0))
        x = x[:, used] / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))
        w, b = np.zeros((len(used), len(FAMILIES))), np.zeros(len(FAMILIES))
        for _ in range(rounds):
            g = (self._softmax(x @ w + b) - y) * weight / weight.sum()
            w -= rate * len(FAMILIES) * (x.T @ g + ridge * w / len(FAMILIES))
            b -= rate * g.sum(axis=0)
        self.weights = np.zeros((BUCKETS, len(FAMILIES)))
        self.weights[used], self.bias = w, b
        self.temperature = self._calibrated(x @ w + b, y)

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def _calibrated(self, z: np.ndarray, y: np.ndarray) -> float:
        """The temperature with the least log loss when a twentieth of all mass is held for the unknown class."""
        tried = np.linspace(0.2, 3, 57)
        soft = 0.95 * y + 0.05 * np.eye(y.shape[1])[-1]
        return float(tried[np.argmin([-(soft * np.log(self._softmax(z / t) + 1e-12)).sum() for t in tried])])


def _numbers(values: list, kind: str) -> Column:
    """A constant array of bounded length; folded to one literal when the plan is made."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def _trained(spark) -> Model:
    def hash_of(grams: list[str]) -> dict[str, int]:
        rows = spark.createDataFrame([(g,) for g in grams], "g string").select("g", F.pmod(F.xxhash64("g"), F.lit(BUCKETS)).alias("k"))
        return {r["g"]: r["k"] for r in rows.collect()}

    return Model(hash_of)


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """A column that the plan works out once, however often it is used."""
    return df.withColumn(name, F.explode(F.array(value)))


def _joined(n: int):
    return lambda i: F.array_join(F.slice("words", i, F.lit(n)), " ")


def _adding(table: Column):
    return lambda s, p: s + F.get(table, p)


def find_licences(docs: DataFrame, least: float = 0.5, similar: float = 0.5) -> DataFrame:
    """(doc_id, line_no, family, probability, similarity, confirmed) of each paragraph with licence words.

    Paragraphs are lines. Features are words and runs of two and three words that hold an anchor word; a paragraph
    without one scores as unknown by its bias alone, so only the others are scored: that is exact, not a shortcut.
    The family is the likeliest one; unknown if its calibrated probability is below `least`, or if less than `similar`
    of the words of the paragraph and of a template of the family agree (the larger of Jaccard similarity and the
    share of the paragraph's words in one template, for paragraphs of four words or more). The model is fitted on the
    driver from the fixed templates, a bounded set, and becomes constants of the plan.

    Null and empty texts have no paragraph; repeated rows are scored each; an empty table gives no rows; extra columns
    are ignored. Ties go to the family first in FAMILIES.
    """
    model = _trained(docs.sparkSession)
    low = F.translate("line", UPPER, LOWER)
    lines = docs.where("text is not null").select("doc_id", F.posexplode(F.split(F.col("text").cast("string"), "\n", -1)).alias("line_no", "line"))
    lines = lines.where(low.rlike(_ANCHORED))
    lines = _once(lines, "words", F.regexp_extract_all(low, F.lit(f"({_WORD})"), F.lit(1)))
    anchored = lambda g: F.concat(F.lit(" "), g).rlike(" (?:" + "|".join(ANCHORS) + ")")
    runs = [F.col("words")]
    for n in (2, 3):
        last = F.size("words") - n + 1
        starts = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
        runs.append(F.transform(starts, _joined(n)))
    grams = F.array_distinct(F.filter(F.concat(*runs), anchored))
    lines = _once(lines, "places", F.transform(grams, lambda g: F.pmod(F.xxhash64(g), F.lit(BUCKETS)).cast("int")))
    lines = lines.where(F.size("places") > 0)
    scale = F.sqrt(F.size("places").cast("double")) * model.temperature
    scores = []
    for k in range(len(FAMILIES)):
        table = _numbers(model.weights[:, k].tolist(), "double")
        total = F.aggregate("places", F.lit(0.0), _adding(table))
        scores.append(total / scale + float(model.bias[k] / model.temperature))
    lines = _once(lines, "scores", F.array(*scores))
    lines = lines.withColumn("top", F.array_max("scores"))
    mass = F.aggregate("scores", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("top")))
    place = F.array_position(F.col("scores"), F.col("top")).cast("int")
    lines = lines.select("doc_id", "line_no", "words", (1 / mass).alias("probability"), F.get(F.array(*[F.lit(f) for f in FAMILIES]), place - 1).alias("guess"))
    own = F.array_distinct("words")
    near = F.lit(0.0)
    for family, texts in TEMPLATES.items():
        best = []
        for t in texts:
            words = F.split(F.lit(" ".join(sorted(set(words_of(t))))), " ")
            shared = F.size(F.array_intersect(own, words)).cast("double")
            inside = F.when(F.size(own) >= 4, shared / F.size(own)).otherwise(0.0)
            best.append(F.greatest(shared / F.size(F.array_union(own, words)), inside))
        near = F.when(F.col("guess") == family, reduce(F.greatest, best)).otherwise(near)
    lines = _once(lines, "similarity", near)
    confirmed = (F.col("guess") != "unknown") & (F.col("probability") >= least) & (F.col("similarity") >= similar)
    return lines.select(
        "doc_id",
        F.col("line_no").cast("long").alias("line_no"),
        F.when(confirmed, F.col("guess")).otherwise("unknown").alias("family"),
        F.round("probability", 6).alias("probability"),
        F.round("similarity", 6).alias("similarity"),
        confirmed.alias("confirmed"),
    )
