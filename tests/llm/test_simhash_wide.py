import random

import numpy as np

import corpus_pipeline as C
from weirflow.llm import simhash_wide as N


def brute(rows):
    """(id, least id that links of five-word Jaccard similarity 0.8 reach)."""
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    comp = list(range(len(rows)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or len(a & b) >= 0.8 * len(a | b):
                comp[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[find(i)] = min(ids.get(find(i), d), d)
    return sorted(((d, ids.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def edited(rnd, words, edits):
    out = list(words)
    for k in range(edits):
        out[rnd.randrange(len(out))] = f"new{rnd.random()}"
    return " ".join(out)


def corpus():
    rnd, rows = random.Random(11), []
    for size, edits in [(300, (0, 1, 3, 5, 6, 7, 9)), (60, (0, 1, 1)), (12, (0, 1))] * 8 + [(200, [k % 5 for k in range(60)])]:
        base = [rnd.choice("abcdefghij") + str(rnd.randrange(400)) for _ in range(size)]
        rows += [(len(rows) + k, edited(rnd, base, e)) for k, e in enumerate(edits)]
    return [*rows, (900, None), (901, " \t"), (902, "a b"), (903, "A  b"), (904, "a b c"), (None, "a b")]


def test_groups_are_those_of_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in N.near_copy_groups(df).collect()), key=str) == brute(rows)
    assert N.near_copy_groups(df.where("false")).collect() == []


def test_stage_drops_copies_of_similarity_0_8(spark, sf):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(str(r.doc_id) for r in C.near_copies(spark, docs, sf).collect()) == sorted(str(d) for d, c in brute(rows) if d == c)


def test_long_runs(spark, monkeypatch):
    monkeypatch.setattr(N, "SHORT_RUN", 3)
    rows = corpus()
    assert sorted((tuple(r) for r in N.near_copy_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str) == brute(rows)


def test_fingerprints_follow_the_similarity():
    """Pairs at the threshold share a block as often as the shape promises, and their prints are near; unlike texts aren't."""
    rng = np.random.default_rng(8)
    bits, blocks = N.shape(100_000)
    shared = far = 0
    for _ in range(150):
        s = np.unique(rng.integers(0, 1 << 62, 900, dtype=np.uint64))
        a, b = s[: len(s) * 9 // 10], s[len(s) // 10 :]
        (pa, ka), (pb, kb) = N.block_values(a, bits, blocks), N.block_values(b, bits, blocks)
        shared += bool((ka == kb).any())
        assert ((pa ^ pb) & (1 << 64) - 1).bit_count() <= N.DISTANCE
        far += ((pa ^ N.block_values(np.unique(rng.integers(0, 1 << 62, 900, dtype=np.uint64)), bits, blocks)[0]) & (1 << 64) - 1).bit_count() > N.DISTANCE
    assert shared >= 0.95 * 150 and far >= 0.97 * 150


def test_fingerprint_bits_are_majorities():
    s = np.random.default_rng(9).integers(0, 1 << 62, 700, dtype=np.uint64)
    flip = np.random.default_rng(7).integers(0, 1 << 63, 3, dtype=np.uint64)
    h = N._mixed((s[:, None] ^ flip) * N._ODD)
    want = [sum(int(x) >> b & 1 for x in h[:, w]) * 2 > 700 for w in range(3) for b in range(64)]
    assert N.fingerprint_bits(s, 170).tolist() == want[:170]
