import random
from collections import Counter, defaultdict
from math import log

import numpy as np

from weirflow.llm import langid as L

LETTERS = L.letter_table()


def slow_model(texts, order=L.ORDER, d=L.DISCOUNT):
    """Interpolated Kneser-Ney by dictionaries: a function of (context, character)."""
    counts = [Counter() for _ in range(order)]
    for t in texts:
        s = " " * order + "".join(map(chr, L.symbols(t, LETTERS)))
        counts[-1].update(s[i - order + 1 : i + 1] for i in range(order, len(s)))
    for n in range(order - 1, 0, -1):
        counts[n - 1].update(g[1:] for g in counts[n])
    total, kinds = defaultdict(int), defaultdict(int)
    for n, cs in enumerate(counts):
        for g, c in cs.items():
            total[n, g[:-1]] += c
            kinds[n, g[:-1]] += 1

    def p(ctx, ch):
        out = 1 / L.ALPHABET
        for n in range(order):
            c = ctx[len(ctx) - n :]
            if total[n, c]:
                out = max(counts[n][c + ch] - d, 0) / total[n, c] + d * kinds[n, c] / total[n, c] * out
        return out

    return p


def slow_score(p, t, order=L.ORDER):
    s = " " * order + "".join(map(chr, L.symbols(t, LETTERS)))
    return sum(log(p(s[:i], s[i])) for i in range(order, len(s)))


def test_equals_the_formula(monkeypatch):
    monkeypatch.setattr(L, "CALIBRATE", 10**9)
    a, b = ["the cat sat on the mat", "that hat, the bat!", "x"], ["der hund und die katze", "das und dies ß"]
    m = L.fit({"a": a, "b": b})
    pa_, pb = slow_model(a), slow_model(b)
    for t in ("the hund sat", "katze", "qqq zzz", "THE Mat 99 on", "ж"):
        got, n = L.score_text(m, t, LETTERS)
        assert n == len(L.symbols(t, LETTERS))
        assert np.allclose(got, [slow_score(pa_, t), slow_score(pb, t)], rtol=1e-5)


def test_long_texts_are_scored_in_parts(monkeypatch):
    m = L.fit({"a": ["abc abd abe"] * 3, "b": ["xyz xyy"]})
    t = "abc xyz abd " * 200
    whole = L.score_text(m, t, LETTERS)
    monkeypatch.setattr(L, "PART", 97)
    part = L.score_text(m, t, LETTERS)
    assert whole[1] == part[1] and np.allclose(whole[0], part[0])


def test_held_out_accuracy_and_contract(spark, sf):
    rows = L.op2_langid(spark, sf).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(lang) and held and all(0 <= r.score <= 1 for r in rows)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)
    assert sum(r.rejected for r in rows) <= 0.01 * len(rows)


def test_edges(spark):
    rnd = random.Random(2)
    m = L.fit({"en": [" ".join(rnd.choice("the of and cat mat hat on is".split()) for _ in range(90)) for _ in range(12)]})
    noise = "".join(chr(rnd.randrange(0x4E00, 0x9000)) for _ in range(300))
    texts = [None, "", " 123 ..", "the cat is on the mat and the hat", noise, "the mat " * 60_000, "the mat"]
    df = spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts)] * 2, "doc_id long, text string, lang_pred string")
    got = {r.doc_id: (r.lang_pred, r.lang_rejected) for r in L.identify(df, m).collect()}
    assert [got[i] for i in range(7)] == [("und", True)] * 3 + [("en", False), ("en", True), ("en", False), ("en", False)]
    assert L.identify(df.where("false"), m).collect() == []
    none = L.train(df.selectExpr("doc_id", "text", "cast(null as string) as lang"))
    assert {(r.lang_pred, r.lang_rejected) for r in L.identify(df, none).collect()} == {("und", True)}


def test_sample_is_bounded(spark):
    df = spark.range(3000).selectExpr("id as doc_id", "concat('text ', id) as text", "if(id % 3 = 0, 'a', 'b') as lang")
    from pyspark.sql import functions as F

    got = L.sample(df, F.lit(True), "doc_id", "text", "lang", texts=100)
    assert {k: len(v) for k, v in got.items()} == {"a": 100, "b": 100}
