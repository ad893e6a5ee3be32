import random
from collections import defaultdict

import numpy as np

from weirflow.llm import line_dedup as D


def brute(rows, similar=0.8):
    """rows: (id, text) with distinct ids, in order."""
    lines = [(d, i, x) for d, t in rows for i, x in enumerate((t or "").split("\n")) if x.strip(" \t\r\x0b\x0c")]
    texts = sorted({x for *_, x in lines})
    up = {x: x for x in texts}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(texts):
        for b in texts[:i]:
            if abs(len(a) - len(b)) < 0.3 * max(len(a), len(b)) + 3 and D.jaccard(a, b) >= similar:
                up[find(a)] = find(b)
    seen, out = set(), defaultdict(set)
    for d, i, x in lines:
        if find(x) in seen:
            out[d].add(i)
        seen.add(find(x))
    return sorted((d, "\n".join(x for i, x in enumerate((t or "").split("\n")) if i not in out[d]), sum(1 for e in lines if e[0] == d), len(out[d])) for d, t in rows)


def corpus(rnd, groups=25, variants=4):
    letters = "abcdefghijklmnopqrstuvwxyzäé "
    base = ["".join(rnd.choice(letters) for _ in range(rnd.choice([5, 30, 120, 300]))) for _ in range(groups)]
    pool = []
    for x in base:
        pool.append(x)
        for _ in range(variants):
            y = list(x)
            for _ in range(rnd.choice([1, 1, 2, 6])):
                y[rnd.randrange(len(y))] = rnd.choice(letters)
            pool += ["".join(y), x + rnd.choice("!?.")]
    return [(k, "\n".join(rnd.choice(pool) for _ in range(rnd.randrange(1, 9)))) for k in range(60)]


def run(spark, rows):
    df = spark.createDataFrame([(d, t, 3, "h") for d, t in rows], "doc_id long, text string, n_lines int, h string")
    return sorted((r.doc_id, r.text, r.n_lines, r.n_removed) for r in D.dedup_lines(df).where("h = 'h'").collect())


def test_matches_brute_force(spark):
    rows = corpus(random.Random(4)) + [(100, None), (101, ""), (102, "\n \n\t\n"), (103, "a\n\na"), (104, "long line " * 9000 + "\nend")]
    assert run(spark, rows) == brute(rows)


def test_long_runs_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(D, "RUN", 3)
    rows = corpus(random.Random(6), groups=4, variants=40)
    assert run(spark, rows) == brute(rows)


def test_null_and_repeated_ids(spark):
    t = "one line of some length that both have"
    df = spark.createDataFrame([(None, t), (3, t), (3, t), (3, t + "\nother thing altogether, quite long"), (None, "x")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_removed, r.text) for r in D.dedup_lines(df).collect()), key=str)
    assert sum(r[0] == 3 and r[1] == 0 for r in got) in (1, 2) and (None, 1, "") in got and (None, 0, "x") in got and len(got) == 5
    assert run(spark, []) == []


def test_signatures_estimate_similarity():
    rnd = random.Random(1)
    a = "".join(rnd.choice("abcdefgh ") for _ in range(2000))
    b = a[:1900] + "".join(rnd.choice("xyz") for _ in range(100))
    k = D.band_keys([a, b, a, "short", "tiny"])
    assert (k[0] == k[2]).all() and (k[3] != k[4]).all() and 0.4 < np.mean(k[0] == k[1]) <= 1


def test_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    want = {d: (n, m, len(t.encode())) for d, t, n, m in brute(docs)}
    assert {r.doc_id: (r.n_lines, r.n_removed, r.kept_bytes) for r in D.op6_line_dedup(spark, sf).collect()} == want


def test_pieces_are_compared_exactly():
    rnd = random.Random(8)
    wide = "".join(map(chr, range(0x4E00, 0x4E00 + 500))) + "😀\0ab"
    pieces = []
    for k in range(60):
        base = "".join(rnd.choice(wide if k % 2 else "abc") for _ in range(rnd.choice([0, 1, 7, 8, 40, 200])))
        pieces.append([base, base + "\0", *["".join(c if rnd.random() > 0.01 else "x" for c in base) + rnd.choice(["", "yz", "\0\0"]) for _ in range(rnd.randrange(8))]])
    lines, starts = [x for p in pieces for x in p], list(np.cumsum([0, *map(len, pieces)])[:-1].tolist())

    def roots(n, links):
        up = list(range(n))

        def find(x):
            return x if up[x] == x else find(up[x])

        for a, b in links:
            up[find(max(a, b))] = find(min(a, b))
        return [min(j for j in range(n) if find(j) == find(i)) for i in range(n)]

    every = [(s + i, s + j) for s, p in zip(starts, pieces, strict=True) for j in range(len(p)) for i in range(j) if D.jaccard(p[i], p[j]) >= 0.8]
    assert roots(len(lines), D.spanning(lines, starts, 0.8)) == roots(len(lines), every)


def test_large_groups_take_few_comparisons(spark, monkeypatch):
    """Runs are cut into parts and what these leave is joined: as by brute force, and far from all pairs are compared."""
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(2, 9))) for _ in range(400)]
    base = [[rnd.choice(words) for _ in range(60)] for _ in range(3)]
    pool = []
    for k in range(120):
        x = list(base[k % 3])
        for _ in range(rnd.choice([0, 1, 2, 3, 5, 7])):
            x[rnd.randrange(60)] = rnd.choice(words)
        pool.append(" ".join(x))
    pool += [" ".join(base[0][:30] + base[1][30:]), "short", "short!"]
    rows = [(k, "\n".join(rnd.choice(pool) for _ in range(4))) for k in range(40)]
    for size in (4096, 64):
        monkeypatch.setattr(D, "RUN", size)
        assert run(spark, rows) == brute(rows)


def test_joining_equals_all_pairs(monkeypatch):
    rnd = random.Random(9)
    monkeypatch.setattr(D, "AT_ONCE", 8)
    for _ in range(30):
        base = "".join(rnd.choice("abcdefgh ") for _ in range(rnd.choice([3, 40, 150])))
        lines = list({"".join(c if rnd.random() > rnd.choice([0, 0.01, 0.02]) else "x" for c in base) + rnd.choice(["", "y", "zz" * 9]) for _ in range(25)})
        roots = [rnd.randrange(8) for _ in lines]

        def parts(links):
            up = list(range(8))
            for a, b in links:
                up = [up[a] if r == up[b] else r for r in up]
            return [up.index(r) for r in up]

        every = [(a, b) for x, a in zip(lines, roots, strict=True) for y, b in zip(lines, roots, strict=True) if a != b and D.jaccard(x, y) >= 0.8]
        assert parts(D.joining(lines, roots, 0.8)) == parts(every)


def test_parts_that_are_connected_are_not_compared_again(spark, monkeypatch):
    """Of long runs only lines of different components meet again; all pairs of blocks of them did before."""
    monkeypatch.setattr(D, "RUN", 16)
    runs = spark.createDataFrame([(1, h) for h in range(200)] + [(2, h) for h in range(300, 500)], "run long, h long")
    labels = spark.createDataFrame([(h, 0) for h in range(200)] + [(h, 300) for h in range(300, 490)], "node long, root long")
    long = spark.createDataFrame([(1, 200, 0), (2, 200, 300)], "run long, n long, first long")
    got = D._left(runs, long, labels).collect()
    assert {r.run for r in got} == {2} and {r.h for r in got} == set(range(300, 500))
    meet = {(a.h, b.h) for a in got if a.h >= 490 for b in got if (a.i, a.j) == (b.i, b.j)}
    assert meet == {(a, b) for a in range(490, 500) for b in range(300, 500)}
    assert len(got) <= 2 * 190 + 10 * 26


def test_lines_that_stay_alone_are_not_looked_up_one_by_one(monkeypatch):
    """Lines of a long run that link with none took all their shingles against all lines before."""
    rnd, looked = random.Random(12), [0]
    words = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randrange(2, 9))) for _ in range(3000)]
    base = rnd.choices(words, k=50)
    lines = list({" ".join(w if rnd.random() > (0.02 if k % 2 else 0.2) else rnd.choice(words) for w in base) for k in range(400)})
    links = D.spanning(lines, [0], 0.8)
    roots = list(range(len(lines)))
    for a, b in links:
        roots = [roots[a] if r == roots[b] else r for r in roots]
    places = D.places

    def counted(begin, n):
        looked[0] += int(n.sum())
        return places(begin, n)

    monkeypatch.setattr(D, "places", counted)
    assert D.joining(lines, roots, 0.8) == []
    alone = [x for x, r in zip(lines, roots, strict=True) if roots.count(r) == 1]
    assert len(alone) > 100 and looked[0] < len(alone) * 50 * 16
    some = rnd.sample(range(len(lines)), 300)
    mixed = [r if k in some else 10_000 + k for k, r in enumerate(roots)]
    up = {r: r for r in mixed}
    for a, b in D.joining(lines, mixed, 0.8):
        up = {r: up[a] if x == up[b] else x for r, x in up.items()}
    found = [up[r] for r in mixed]
    assert [found.index(r) for r in found] == [roots.index(r) for r in roots]
