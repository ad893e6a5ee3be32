import random

import xxhash

from weirflow.llm import simhash as S

SCHEMA = "doc_id long, text string, fingerprint int, root string"


def slow_print(text, n=3):
    words = [w for w in (text or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))).split()]
    if not words:
        return 0
    sh = [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows, distance=3):
    fp = [slow_print(t) for _, t in rows]
    comp = list(range(len(rows)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= distance:
                comp[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[find(i)] = min(ids.get(find(i), d), d)
    return sorted(((d, f"{fp[i]:016x}", ids.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def rows_of(spark, rows):
    df = spark.createDataFrame([(d, t, 7, "x") for d, t in rows], SCHEMA)
    return sorted((tuple(r) for r in S.simhash_groups(df).collect()), key=str)


def test_matches_brute_force(spark):
    rnd = random.Random(3)
    vocab = [f"w{k}é" for k in range(60)]
    rows = []
    for k in range(40):
        base = [rnd.choice(vocab) for _ in range(rnd.choice([1, 2, 3, 40, 200]))]
        rows.append((len(rows), " ".join(base)))
        for _ in range(3):
            other = list(base)
            other[rnd.randrange(len(other))] = rnd.choice(vocab)
            rows.append((len(rows), "\n".join(other).upper()))
    rows += [(900, None), (901, ""), (902, " \t"), (None, "a b c d"), (903, "A b c d"), (903, "A b c d"), (904, "z " * 50_000)]
    assert rows_of(spark, rows) == brute(rows)


def test_empty(spark):
    assert rows_of(spark, []) == []


def test_hot_runs_are_split_without_losing_links(spark, monkeypatch):
    monkeypatch.setattr(S, "HOT_RUN", 30)
    rnd = random.Random(5)
    base = rnd.getrandbits(64)
    prints = {base ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(5))) for _ in range(300)}
    df = spark.createDataFrame([(S._signed(x),) for x in prints], "fp long")
    got = {(r.a, r.b) for r in S.near_fingerprints(df).collect()}
    ps = [S._signed(x) for x in prints]

    def groups(links):
        up = {p: p for p in ps}

        def find(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in links:
            up[find(a)] = find(b)
        return {frozenset(p for p in ps if find(p) == r) for r in ps if find(r) == r}

    true = {(a, b) for a in ps for b in ps if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 3 for a, b in got)
    assert groups(got) == groups(true)
