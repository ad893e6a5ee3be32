import hashlib
import random

import numpy as np
import pytest

from weirflow.llm import suffix_dedup as D


def brute(rows, length=100):
    """rows: (id, text), ids distinct and in order."""
    seen, out = set(), []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, n_bytes string, lo int")
    return sorted(tuple(r) for r in D.drop_repeats(df, **kw).collect())


def corpus(rnd):
    vocab = ["alpha", "béta", "gamma", "delta", "eps", "zeta", "x"]
    prose = lambda n: " ".join(rnd.choice(vocab) + str(rnd.randrange(30)) for _ in range(n))
    shared = [prose(40) for _ in range(4)]
    rows = []
    for k in range(60):
        t = prose(rnd.randrange(60))
        for _ in range(rnd.randrange(4)):
            p = rnd.choice(shared)
            a = rnd.randrange(60)
            t += p[a : a + rnd.choice([98, 99, 100, 101, 160, 400])] + prose(rnd.randrange(20))
        if k % 7 == 3:
            t = rows[rnd.randrange(len(rows))][1]
        if k % 11 == 5:
            t = list(rows[rnd.randrange(len(rows))][1] or "e")
            t[len(t) // 2] = "!"
            t = "".join(t)
        rows.append((k * 3, t))
    return rows + [(500, None), (501, ""), (502, "ab" * 300), (503, "z" * 250), (504, "z" * 150), (505, prose(3000) * 2)]


def test_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(D, "SCAN", 4096)
    rows = corpus(random.Random(7))
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("group", [1, 2, 5])
def test_large_groups_are_halved(spark, monkeypatch, group):
    monkeypatch.setattr(D, "GROUP", group)
    monkeypatch.setattr(D, "ORDERED", 500)
    rows = corpus(random.Random(8 + group))
    assert run(spark, rows) == brute(rows)


def test_common_passage_with_many_ends(spark, monkeypatch):
    monkeypatch.setattr(D, "GROUP", 8)
    rnd = random.Random(3)
    passage = "".join(rnd.choice("abcdefgh ") for _ in range(180))
    rows = [(k, f"{k * 7919}{passage}{k * 104729}"[rnd.randrange(3) :]) for k in range(200)]
    assert run(spark, rows) == brute(rows)


def test_on_documents(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    assert sorted(tuple(r) for r in D.op7_suffix_dedup(spark, sf).collect()) == brute(docs)


def test_repeated_and_null_ids(spark):
    t = "".join(chr(97 + k * k % 26) + str(k) for k in range(80))
    got = run(spark, [(1, t), (1, t), (2, t)]) + run(spark, []) + [tuple(r) for r in D.drop_repeats(spark.createDataFrame([(None, t), (9, t)], "doc_id long, text string")).collect() if r.doc_id is None]
    n = len(t)
    assert [(r[0], r[2]) for r in got] == [(1, 0), (1, 0), (2, n), (None, n)]


def test_longest_previous_factors():
    rnd = np.random.default_rng(5)
    for depth, letters in ((8, 2), (32, 2), (100, 1), (40, 3)):
        t = rnd.integers(97, 97 + letters, 300).astype(np.uint8)
        t[150:250] = t[20:120]
        starts = np.arange(0, 300 - depth)
        place = rnd.permutation(len(starts))
        got = D.longest_previous(t, starts, place, depth)
        for i in range(len(starts)):
            best = 0
            for j in np.flatnonzero(place < place[i]):
                k = 0
                while k < depth and t[starts[i] + k] == t[starts[j] + k]:
                    k += 1
                best = max(best, k)
            assert got[i] == (best if best == depth else best // 8 * 8)


def test_previous_smaller():
    x = np.random.default_rng(6).permutation(500)
    for v in (x, np.sort(x), np.sort(x)[::-1]):
        want = [max((j for j in range(i) if v[j] < v[i]), default=-1) for i in range(500)]
        assert D.previous_smaller(v).tolist() == want
