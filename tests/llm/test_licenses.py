import re
from collections import defaultdict

import pytest

from weirflow.llm import licenses as L


@pytest.fixture(scope="module")
def model(spark, sf):
    return L.train(spark.read.parquet(f"{sf}/documents.parquet"))


def slow(rows, model):
    out = defaultdict(list)
    for d, t in rows:
        for no, line in enumerate((t or "").split("\n")):
            fs = L.features(line)
            p = model.probabilities(fs)
            k = max(range(len(p)), key=lambda i: p[i])
            own = {f for f in fs if " " in f}
            if not any(map(L.is_pair, own)) or p[k] < model.threshold:
                continue
            sims = [len(own & g) / min(len(own), len(g)) for x in L.TEMPLATES[model.families[k]] if (g := {f for f in L.features(x) if " " in f})]
            pairs = {f for ts in L.TEMPLATES.values() for x in ts for f in L.features(x) if L.is_pair(f)}
            if max(sims) >= L.SIMILAR and own & pairs:
                out[d, model.families[k]].append((no, p[k], max(sims)))
    return sorted((d, f, len({x[0] for x in v}), min(x[0] for x in v), round(max(x[1] for x in v), 6), round(max(x[2] for x in v), 6)) for (d, f), v in out.items())


def run(df, model):
    return sorted((r.doc_id, r.family, r.n_paragraphs, r.first_paragraph, round(r.probability, 6), round(r.similarity, 6)) for r in L.scan(df, model).collect())


def test_matches_plain_python(spark, sf, model):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    docs = [(r.doc_id, r.text) for r in df.collect()]
    got = run(df, model)
    assert got == slow(docs, model)
    # Every notice of the corpus is found, under its family, and nothing else is.
    want = {(d, f) for d, t in docs for f, s in {"MIT": "under the MIT License", "Apache": "Apache License, Version", "GPL": "GNU General Public License", "CC-BY-NC": "CC BY-NC", "Proprietary": "All rights reserved"}.items() if s in t}
    assert want and {g[:2] for g in got} == want


def test_variants_and_edges(spark, model):
    texts = {
        1: "intro\nreleased under  the MIT license\nend",
        2: "This File is licensed under the Apache License, Version 2.0 (see NOTICE).",
        3: "the license of the poet was under the version of events that he released",
        4: "Licensed under the GNU Lesser General Public License, version 2.1",
        5: None,
        6: "",
        7: "x " * 100_000 + "\nLicensed under CC BY-NC 4.0.",
        8: "Released under the MIT License.\nLicensed under CC BY-NC 4.0.\nReleased under the MIT License.",
    }
    wrapped = ["Redistributions in binary form must", "reproduce the above copyright notice,", "this list of conditions and the following", "disclaimer in the documentation and/or", "other materials provided with the", "distribution."]
    texts |= {9: "prose before it\n" + "\n".join(wrapped) + "\nprose after it", 10: " ".join(wrapped), 11: "x\nLicense: Apache-2.0\ny"}
    df = spark.createDataFrame([(d, t, "f", 1) for d, t in texts.items()] * 2, "doc_id long, text string, family string, no int")
    got = {(r[0], r[1]): r[2:4] for r in run(df, model)}
    assert got == {(1, "MIT"): (1, 1), (2, "Apache"): (1, 0), (4, "LGPL"): (1, 0), (7, "CC-BY-NC"): (1, 1), (8, "MIT"): (2, 0), (8, "CC-BY-NC"): (1, 1), (9, "BSD"): (1, 1), (10, "BSD"): (1, 0), (11, "Apache"): (1, 1)}
    assert run(df.where("false"), model) == []
    assert L.train(df.where("false")).threshold == 0.5
    plan = L.scan(df, model)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_cover_holds_a_word_of_every_pair():
    pairs = sorted({f for ts in L.TEMPLATES.values() for x in ts for f in L.features(x) if L.is_pair(f)})
    words = L.cover(pairs)
    assert all(set(words) & set(p.split(" ")) for p in pairs) and len(words) < len(pairs) / 2
    some = re.compile(L.word_pattern(words))
    assert all(some.search(p) for p in pairs) and all(some.search(f"x {w}.") for w in words) and not some.search("xlicensed")


def test_held_out_wordings(spark, model):
    """Notices in words of their own, told apart from prose on the same subjects."""
    notices = {
        "MIT": ["This library is released under the MIT license", "code licensed under the terms of the MIT License"], "Apache": ["Distributed under the Apache License, Version 2.0", "licensed under the Apache License, Version 2.0 by its authors"],
        "GPL": ["it is free software under the GNU General Public License, version 3", "released under the GNU General Public License"], "LGPL": ["under the terms of the GNU Lesser General Public License, version 2.1"],
        "AGPL": ["licensed under the GNU Affero General Public License, version 3 or later"], "BSD": ["Distributed under the BSD license", "Redistribution and use in source and binary forms are permitted"],
        "MPL": ["subject to the terms of the Mozilla Public License, version 2.0"], "CC-BY": ["Text licensed under a Creative Commons Attribution 4.0 International License"], "CC0": ["placed in the public domain under CC0 1.0 Universal"],
    }
    prose = ["the apache helicopter needed a licence", "a general of the public school", "free of charge to any person who asked", "he wrote software in the public library", "all rights and duties", "the license plate of the car", "copyright law is complicated", "version 2.0 of the story"]
    rows = [(f, x) for f, xs in notices.items() for x in xs] + [(None, x) for x in prose]
    df = spark.createDataFrame([(k, x) for k, (_, x) in enumerate(rows)], "doc_id long, text string")
    got = {(r.doc_id, r.family) for r in L.scan(df, model).collect()}
    want = {(k, f) for k, (f, _) in enumerate(rows) if f}
    assert len(got & want) >= 0.7 * len(want) and len(got & want) >= 0.9 * len(got)
