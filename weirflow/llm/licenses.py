"""License scans: a trained paragraph classifier over sparse word n-grams, confirmed by template comparison.

The classifier is fitted on the driver on templates and a bounded sample of the corpus; all that reads the corpus is DataFrame
functions, and what they join with (n-grams of the templates) is a broadcast of fixed size.
"""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weirflow.llm.common import save, session, table

UNKNOWN = "unknown"

#: Usual notices and sentences by which a license family is known.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license, see the LICENSE file.",
        "SPDX-License-Identifier: MIT",
        "License: MIT",
        "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "Apache": [
        "Licensed under the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
        "License: Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, without warranties or conditions of any kind.",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "SPDX-License-Identifier: GPL-2.0-only",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "Released under the GPL, version 2.",
    ],
    "LGPL": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License.",
    ],
    "AGPL": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ],
    "BSD": [
        "Released under the BSD License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "License: BSD-3-Clause",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ],
    "MPL": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
        "License: MPL-2.0",
        "If a copy of the MPL was not distributed with this file, you can obtain one at mozilla.org.",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
        "Licensed under CC BY-NC-SA 4.0.",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
        "Licensed under CC BY-SA 4.0.",
    ],
    "CC0": [
        "Dedicated to the public domain under CC0 1.0 Universal.",
        "SPDX-License-Identifier: CC0-1.0",
        "This is free and unencumbered software released into the public domain.",
    ],
    "ISC": [
        "Released under the ISC License.",
        "SPDX-License-Identifier: ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    ],
    "Proprietary": [
        "All rights reserved.",
        "All rights reserved. No part of this publication may be reproduced without prior written permission of the publisher.",
        "This software is proprietary and confidential; unauthorized copying of this file is strictly prohibited.",
    ],
}
#: Words too common to tell a license by; a pair of them is no feature.
STOP = set("a an and any are as at be by can for from has have in is it its no not of on or shall that the their them this to under was were which will with you your".split())
#: The bound on the corpus sample that stands for the unknown class: about so many documents, paragraphs of them, and characters of
#: each.
FIT_DOCS, FIT_PARAGRAPHS, FIT_CHARS = 200, 2000, 2000
EPOCHS, RATE, DECAY = 60, 0.5, 1e-4
#: A prediction is confirmed if this share of the paragraph's or of a template's word pairs is common to both.
SIMILAR = 0.6
#: Lines of a run of hits that are taken together at most; a longer run is taken in parts.
WRAPPED = 12
#: A paragraph is a line, and also what neighbouring lines that may belong to a notice make together, as notices are wrapped; its
#: words are runs of these characters.
PARAGRAPH, NO_WORD = "\n", "[^a-z0-9.]+"


def features(text: str) -> list[str]:
    """Distinct words and pairs of neighbouring words; a full stop at the end of a word isn't part of it."""
    ws = [w.strip(".") for w in re.split(NO_WORD, text.lower())]
    ws = [w for w in ws if w]
    return sorted({*ws, *(f"{a} {b}" for a, b in zip(ws, ws[1:], strict=False))})


def is_pair(f: str) -> bool:
    """Whether f is a pair that can tell a license."""
    return " " in f and not STOP.issuperset(f.split(" "))


def cover(pairs: list[str]) -> list[str]:
    """Words of which each pair holds one, the fewest that greedy search finds."""
    left, out = [set(p.split(" ")) - STOP for p in pairs], []
    while left:
        count: dict[str, int] = {}
        for p in left:
            for w in p:
                count[w] = count.get(w, 0) + 1
        best = max(sorted(count), key=lambda w: (count[w], len(w)))
        out.append(best)
        left = [p for p in left if best not in p]
    return sorted(out)


def word_pattern(words: list[str]) -> str:
    """A regular expression that finds any of the words as a whole one, with alternatives by first letter, so that few are tried."""
    by_letter: dict[str, list[str]] = {}
    for w in sorted(words, key=lambda w: (-len(w), w)):
        by_letter.setdefault(w[0], []).append(re.escape(w[1:]))
    tries = "|".join(f"{re.escape(c)}(?:{'|'.join(ws)})" for c, ws in sorted(by_letter.items()))
    return f"(?<![a-z0-9])(?:{tries})(?![a-z0-9])"


@dataclass
class Classifier:
    families: list[str]
    #: Feature -> weight by family; the unknown class has weight 0, and `bias` is what families have beside it.
    weights: dict[str, list[float]]
    bias: list[float]
    threshold: float

    def probabilities(self, fs: list[str]) -> list[float]:
        z = list(self.bias)
        for f in fs:
            for k, w in enumerate(self.weights.get(f, ())):
                z[k] += w
        top = max(0.0, *z)
        e = [math.exp(x - top) for x in z]
        total = sum(e) + math.exp(-top)
        return [x / total for x in e]


def fit(negatives: list[str]) -> Classifier:
    """Multinomial logistic regression by AdaGrad on the templates, their halves, and paragraphs of no license. Every other
    negative is left out and calibrates: the threshold lies above what nearly all of those reach."""
    families = sorted(TEMPLATES)
    rows: list[tuple[list[str], int]] = []
    for k, fam in enumerate(families):
        for t in TEMPLATES[fam]:
            rows.append((features(t), k))
            ws = t.split()
            if len(ws) > 12:
                rows += [(features(" ".join(ws[: len(ws) // 2])), k), (features(" ".join(ws[len(ws) // 2 :])), k)]
    vocabulary = {f for fs, _ in rows for f in fs if " " not in f or is_pair(f)}
    known = lambda t: [f for f in features(t) if f in vocabulary]
    rows = [([f for f in fs if f in vocabulary], k) for fs, k in rows]
    rows += [(known(t), -1) for t in negatives[::2]]
    n = len(families)
    model = Classifier(families, {f: [0.0] * n for f in sorted(vocabulary)}, [-2.0] * n, 0.5)
    seen = {f: [1e-2] * n for f in vocabulary}
    for _ in range(EPOCHS):
        for fs, label in rows:
            p = model.probabilities(fs)
            for k in range(n):
                g = p[k] - (k == label)
                if abs(g) < 1e-3:
                    continue
                for f in fs:
                    w = model.weights[f]
                    d = g + DECAY * w[k]
                    seen[f][k] += d * d
                    w[k] -= RATE * d / math.sqrt(seen[f][k])
    top = sorted(max(model.probabilities(known(t))) for t in negatives[1::2])
    if top:
        model.threshold = min(0.95, max(0.5, top[min(len(top) - 1, int(0.999 * len(top)))] + 0.05))
    return model


def _json_values(spark: SparkSession, text: str, schema: str) -> DataFrame:
    """A local table."""
    return spark.range(1).select(F.explode(F.from_json(F.lit(text), f"array<struct<{schema}>>")).alias("x")).select("x.*")


def words_of(paragraph: Column) -> Column:
    ws = F.transform(F.split(F.lower(paragraph), NO_WORD), lambda w: F.btrim(w, F.lit(".")))
    return F.filter(ws, lambda w: w != "")


def pairs_of(ws: Column) -> Column:
    return F.when(F.size(ws) > 1, F.zip_with(F.slice(ws, 1, F.greatest(F.size(ws) - 1, F.lit(0))), F.slice(ws, 2, F.greatest(F.size(ws) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))


def paragraphs(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, no, line) of all paragraphs, numbered from 0 in each text."""
    return df.select(F.col(id_col).cast("long").alias("id"), F.posexplode(F.split(F.col(text_col), PARAGRAPH)).alias("no", "line")).where("line <> ''")


def scan(df: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """License notices in all paragraphs of all texts of df.

    Returns one row per id and family found: id_col, family, n_paragraphs, first_paragraph (from 0), probability and similarity
    (the highest of its paragraphs). A paragraph counts if the classifier gives a family at least the calibrated threshold and a
    template of that family has SIMILAR of its word pairs in common; none can without a pair of a template, so the rest
    are dropped first. Lines next to each other that may belong to a notice are also taken together, as notices are wrapped. Of
    families that tie the first by name counts. Null, empty and unrelated texts give no row; rows of equal id count as one text, equal
    lines at one place of it as one; null ids are one id; texts of any length are scanned whole; extra columns are ignored; an empty
    table gives no rows. Everything here is DataFrame functions.
    """
    spark = session(df.sparkSession)
    pairs = sorted({f for ts in TEMPLATES.values() for t in ts for f in features(t) if is_pair(f)})
    # A pair of a template takes a word of the cover, so texts and lines that contain none are out before words are made.
    some = word_pattern(cover(pairs))
    lines = paragraphs(df.where(F.lower(text_col).rlike(some)), id_col, text_col).where(F.lower("line").rlike(some))
    hint = F.array(*[F.lit(p) for p in pairs])
    hits = save(lines.where(F.arrays_overlap(pairs_of(words_of(F.col("line"))), hint)).distinct(), "notices")
    # Neighbouring lines with a hit make one paragraph more, up to WRAPPED of them at a time.
    by_text = Window.partitionBy("id").orderBy("no", "line")
    turn = F.dense_rank().over(by_text) - F.col("no")
    runs = hits.withColumn("run", turn).withColumn("part", F.floor((F.col("no") - F.min("no").over(Window.partitionBy("id", "run"))) / WRAPPED))
    joined = runs.groupBy("id", "run", "part").agg(F.min("no").alias("no"), F.max("no").alias("last"), F.sort_array(F.collect_list(F.struct("no", "line"))).alias("ls")).where(F.col("last") > F.col("no"))
    joined = joined.select("id", "no", "last", F.array_join(F.transform("ls", lambda x: x["line"]), " ").alias("line"))
    found = hits.select("id", "no", F.col("no").alias("last"), "line").union(joined)
    ws = words_of(F.col("line"))
    grams = found.withColumn("ws", ws).select("id", "no", "last", "line", F.explode(F.array_distinct(F.concat("ws", pairs_of(F.col("ws"))))).alias("gram"))
    weights = _json_values(spark, json.dumps([{"gram": g, "w": w} for g, w in model.weights.items()]), "gram string, w array<double>")
    n = len(model.families)
    z = grams.join(F.broadcast(weights), "gram").groupBy("id", "no", "last", "line").agg(*[F.sum(F.col("w")[k]).alias(f"z{k}") for k in range(n)])
    scores = F.array(*[F.coalesce(F.col(f"z{k}"), F.lit(0.0)) + F.lit(model.bias[k]) for k in range(n)])
    top = F.greatest(F.array_max("z"), F.lit(0.0))
    e = z.select("id", "no", "last", "line", scores.alias("z")).withColumn("e", F.transform("z", lambda x: F.exp(x - top)))
    total = F.aggregate("e", F.exp(-top), lambda a, x: a + x)
    best = F.array_position("z", F.array_max("z")).cast("int")
    p = e.select("id", "no", "last", "line", (F.array_max("e") / total).alias("probability"), F.element_at(F.array(*map(F.lit, model.families)), best).alias("family"))
    p = p.where(F.col("probability") >= model.threshold)
    # Template comparison, on pairs of words.
    rows = [{"family": f, "t": f"{f} {i}", "size": len(x), "gram": g} for f, ts in TEMPLATES.items() for i, t in enumerate(ts) for x in [[g for g in features(t) if " " in g]] for g in x]
    templates = _json_values(spark, json.dumps(rows), "family string, t string, size int, gram string")
    own = p.withColumn("g", F.array_distinct(pairs_of(words_of(F.col("line"))))).withColumn("n", F.size("g")).select("id", "no", "last", "line", "family", "probability", "n", F.explode("g").alias("gram"))
    both = own.join(F.broadcast(templates), ["family", "gram"]).groupBy("id", "no", "last", "line", "family", "probability", "n", "t", "size").agg(F.count("*").alias("c"))
    ok = both.withColumn("whole", F.col("c") / F.col("size")).withColumn("similarity", F.greatest(F.col("c") / F.col("n"), "whole")).where(F.col("similarity") >= SIMILAR)
    each = save(ok.groupBy("id", "family", "no", "last").agg(F.max("probability").alias("probability"), F.max("similarity").alias("similarity"), F.max("whole").alias("whole")), "confirmed")
    # A wrapped notice counts once, by its lines together, where none of them alone holds most of a template. Those lines are only parts
    # of it, whatever else they are like.
    one, more = each.where("last = no"), each.where("last > no").select("id", "no", "last", "family", "probability", "similarity", "whole")
    sure = one.where(F.col("whole") >= SIMILAR).select(F.col("id").alias("i"), F.col("no").alias("n"), F.col("family").alias("f"))
    inside = F.col("id").eqNullSafe(F.col("i")) & F.col("n").between(F.col("no"), F.col("last")) & (F.col("family") == F.col("f"))
    wrapped = more.where(F.col("whole") >= SIMILAR).join(sure, inside, "left_anti")
    cover_ = wrapped.select(F.col("id").alias("i"), F.col("no").alias("a"), F.col("last").alias("b"))
    part = F.col("id").eqNullSafe(F.col("i")) & F.col("no").between(F.col("a"), F.col("b")) & (F.col("whole") < SIMILAR)
    alone = one.join(cover_, part, "left_anti")
    kept = alone.union(wrapped.select(*alone.columns))
    return kept.groupBy(F.col("id").alias(id_col), "family").agg(F.count("*").alias("n_paragraphs"), F.min("no").alias("first_paragraph"), F.max("probability").alias("probability"), F.max("similarity").alias("similarity"))


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Classifier:
    """Fit on the templates and at most FIT_PARAGRAPHS paragraphs of at most FIT_CHARS characters of about FIT_DOCS documents of df, by
    least hash, that share no pair of words with a template."""
    n = df.count()
    share = min(1.0, FIT_DOCS / max(1, n))
    some = df.where(F.pmod(F.xxhash64(id_col, text_col), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    lines = paragraphs(some, id_col, text_col).where(F.length("line") <= FIT_CHARS).select("line").distinct()
    rows = lines.orderBy(F.xxhash64("line"), "line").limit(FIT_PARAGRAPHS).collect()
    pairs = {f for ts in TEMPLATES.values() for t in ts for f in features(t) if is_pair(f)}
    return fit([r["line"] for r in rows if pairs.isdisjoint(features(r["line"]))])


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scan of the whole table `documents`, with a classifier fitted on the bounded sample."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(docs, train(docs))
