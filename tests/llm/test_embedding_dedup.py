import numpy as np

from weirflow.llm import embedding_dedup as E


def brute(rows, cosine=0.95):
    n = len(rows)
    x, ok, size = E.unit_vectors([v for _, v in rows])
    link = (x @ x.T >= cosine) & ok[:, None] & ok[None, :] & (size[:, None] == size[None, :])
    np.fill_diagonal(link, False)
    comp = np.arange(n)
    changed = True
    while changed:
        changed = False
        for i in range(n):
            m = min([comp[i], *comp[link[i]]])
            if m < comp[i]:
                comp[i], changed = m, True
    groups = {}
    for i in range(n):
        groups.setdefault(comp[i], []).append(rows[i][0])
    return sorted((rows[i][0], int(link[i].sum()), min(groups[comp[i]]), rows[i][0] == min(groups[comp[i]])) for i in range(n))


def vectors(seed=1, dim=32):
    r = np.random.default_rng(seed)
    rows = []
    for size in [1] * 150 + [2] * 30 + [5] * 10 + [150]:
        c = r.standard_normal(dim)
        for _ in range(size):
            v = c + r.standard_normal(dim) * (0.15 if size > 1 else 0)
            rows.append((len(rows) * 2, [float(a) for a in v.astype(np.float32)]))
    for k in range(40):
        rows.append((5000 + k, rows[3][1]))
    rows += [(9000, None), (9001, [0.0] * dim), (9002, [float("nan")] * dim), (9003, [None] + [1.0] * (dim - 1)), (9004, [float("inf")] + [1.0] * (dim - 1)), (9005, []), (9006, [1e-30 * a for a in rows[5][1]])]
    return rows


def run(spark, rows, **kw):
    df = spark.createDataFrame([(d, v, 1, 2) for d, v in rows], "vec_id long, embedding array<float>, n_links int, label int")
    return sorted(tuple(r) for r in E.near_duplicates(df, **kw).collect())


def test_close_to_brute_force(spark, monkeypatch):
    monkeypatch.setattr(E, "BLOCK", 50)
    rows = vectors()
    got, want = run(spark, rows), brute(rows)
    assert len(got) == len(want)
    total = sum(w[1] for w in want)
    assert sum(g[1] for g in got) >= 0.98 * total and all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
    assert sum(g == w for g, w in zip(got, want, strict=True)) >= 0.95 * len(want)
    assert {g for g in got if g[0] >= 5000} == {w for w in want if w[0] >= 5000}


def test_query_and_empty(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted(tuple(r) for r in E.op3_embedding_dedup(spark, sf).collect()) == brute(rows)
    assert run(spark, []) == []
    df = spark.createDataFrame([(None, [1.0, 2.0]), (4, [1.0, 2.0]), (4, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert sorted((tuple(r) for r in E.near_duplicates(df).collect()), key=str) == [(4, 2, 4, True), (4, 2, 4, True), (None, 2, 4, False)]


def crowd(n, mean, dim=64, seed=9):
    """n vectors around one centre; every third has a link planted at cosine 0.955."""
    r = np.random.default_rng(seed)
    unit = lambda x: x / np.sqrt((x * x).sum(axis=-1, keepdims=True))
    c = unit(r.standard_normal(dim))

    def at(base, cosine):
        w = r.standard_normal(base.shape)
        w = unit(w - (w * base).sum(axis=1, keepdims=True) * base)
        return cosine * base + np.sqrt(1 - cosine**2) * w

    x = at(np.repeat(c[None], n, axis=0), mean)
    x[1::3] = at(x[0::3][: len(x[1::3])], 0.955)
    return [(k, v.tolist()) for k, v in enumerate(x)]


def test_crowds_lose_no_links(spark):
    rows = crowd(3000, 0.9)
    got, want = run(spark, rows), brute(rows)
    assert sum(w[1] for w in want) >= 2000
    assert sum(g[1] for g in got) >= 0.995 * sum(w[1] for w in want)
    assert sum(g == w for g, w in zip(got, want, strict=True)) >= 0.995 * len(want)


def test_passes_follow_the_size():
    assert [E.run_bits(n, 24) for n in (0, 24, 25, 1_600_000)] == [0, 0, 1, 17]
    for bits in (0, 5, 14, 22):
        assert (1 - (1 - np.arccos(0.95) / np.pi) ** bits) ** E.passes_for(bits, 0.95) <= E.MISSED


def test_lengths_are_kept_apart(spark):
    """Vectors of several lengths link within their length, whatever stands beside them."""
    rows = vectors(seed=2, dim=32)[:200]
    more = [(20_000 + d, v) for d, v in vectors(seed=3, dim=16)[-60:] if v]
    more += [(30_000, rows[0][1][:16]), (30_001, rows[0][1][:16] + [0.0] * 16)]
    both = brute(rows + more)
    assert run(spark, rows + more, window=4) == both
    assert run(spark, more) == brute(more)


def test_links_are_thinned_to_a_forest():
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 200, (2, 400))
    c, d = E.forest(a, b, 200)
    label = lambda x, y: [min(g) for g in closure(x, y, 200)]
    assert len(c) == 200 - len(set(label(a, b))) and label(a, b) == label(c, d)


def closure(a, b, n):
    groups = [{i} for i in range(n)]
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        if groups[x] is not groups[y]:
            groups[x] |= groups[y]
            for z in groups[x]:
                groups[z] = groups[x]
    return groups


def test_sql_agrees(spark, tmp_path):
    """The SQL on vectors that do link."""
    import duckdb

    rows = vectors(seed=6, dim=16)
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = con.sql(f"SELECT vec_id, n_links, component_id, kept FROM ({E.OP3_SQL.strip()})").fetchall()
    assert sorted(got) == brute(rows)
