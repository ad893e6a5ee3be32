import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from weirflow.llm import lm_score as M


def slow_words(t):
    out, cur = [], b""
    for c in (t or "").encode():
        if c == 0x20 or 9 <= c <= 13:
            out, cur = out + [cur] if cur else out, b""
        else:
            cur += bytes([c + 32 if 65 <= c <= 90 else c])
    return out + [cur] * bool(cur) + [M.END]


def small(monkeypatch):
    """A small model, so that probabilities can be summed."""
    for k, v in {"HEAD": 8, "CLASS": 4, "BUCKETS": 2, "CLASSES": 4, "EMBED": 3, "HIDDEN": 5}.items():
        monkeypatch.setattr(M, k, v)
    monkeypatch.setattr(M, "SHAPES", {"E": (10, 3), "Wx": (3, 15), "b": (15,), "Wh": (5, 15), "C": (5, 4), "cb": (4,), "O": (8, 5), "ob": (8,)})
    rng = np.random.default_rng(1)
    return {k: rng.standard_normal(s) * 0.5 for k, s in M.SHAPES.items()}


def test_gradients_by_differences(monkeypatch):
    p = small(monkeypatch)
    rng = np.random.default_rng(2)
    ids, target = rng.integers(0, 10, (4, 3)), rng.integers(0, 10, (4, 3))
    fresh, live = rng.random((4, 3)) < 0.3, rng.random((4, 3)) < 0.8
    h = rng.standard_normal((3, 5))

    def loss(p):
        out, _ = M.forward(p, p["E"] @ p["Wx"] + p["b"], ids, fresh, h)
        return -(M.log_probs(p, out.reshape(-1, 5), target.ravel()) * live.ravel()).sum() / live.sum()

    g, _ = M.gradients(p, ids, target, fresh, live, h)
    word, rows = g["E"]
    g["E"] = np.zeros(M.SHAPES["E"])
    g["E"][word] = rows
    for k in p:
        for i in list(np.ndindex(p[k].shape))[::3]:
            was = p[k][i]
            p[k][i] = was + 1e-3
            up = loss(p)
            p[k][i] = was - 1e-3
            down = loss(p)
            p[k][i] = was
            assert abs((up - down) / 2e-3 - g[k][i]) < 2e-3


def test_probabilities_sum_to_one(monkeypatch):
    p = small(monkeypatch)
    hs = np.random.default_rng(3).standard_normal((1, 5))
    assert abs(np.exp(M.log_probs(p, np.repeat(hs, 10, axis=0), np.arange(10))).sum() - 1) < 1e-6


def test_state_is_carried_and_lanes_change_nothing(monkeypatch):
    p = small(monkeypatch)
    rng = np.random.default_rng(4)
    docs = [rng.integers(0, 10, n).astype(np.int32) for n in (1, 70, 3, 40, 9, 33)]
    want = []
    for d in docs:
        out, _ = M.forward(p, p["E"] @ p["Wx"] + p["b"], np.r_[7, d[:-1]][:, None], (np.arange(len(d)) == 0)[:, None], np.zeros((1, 5)))
        want.append(M.log_probs(p, out[:, 0].astype(np.float64), d).sum())
    for k, t in ((2, 5), (100, 32)):
        monkeypatch.setattr(M, "SCORE_LANES", k)
        monkeypatch.setattr(M, "SCORE_STEPS", t)
        assert np.allclose(M.score_docs(p, docs, 7), want, rtol=1e-4)


def test_contract_columns_and_gain(spark, sf, monkeypatch):
    monkeypatch.setattr(M, "KNOWN", 3000)  # so that the counts of many words are joined
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + [(9001, None), (9002, ""), (9003, "A a\x0bb c  Ä"), (None, "null id"), (9004, "again"), (9004, "again")]
    df = spark.createDataFrame([(d, t, 1.5) for d, t in docs], "doc_id long, text string, score double")
    got = M.score_documents(df).collect()
    out = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    counts = Counter(w for d, t in docs if not out(d) for w in slow_words(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(d), out(d), len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), 4)) for d, t in docs for ws in [slow_words(t)])
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_empty(spark):
    assert M.score_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    only = M.score_documents(spark.createDataFrame([(2, "x y")] , "doc_id long, text string")).collect()
    assert len(only) == 1 and math.isfinite(only[0].score) and math.isfinite(only[0].base_score)


def test_averages_of_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(M, "FAN_IN", 3)
    w = [M.start_weights(np.array([5.0]), np.ones(M.BUCKETS)) for _ in range(11)]
    for i, p in enumerate(w):
        p["b"][:] = i
    df = spark.createDataFrame([(i, i + 1, bytearray(M.pack_weights(p))) for i, p in enumerate(w)], "task long, n long, data binary")
    want = sum(i * (i + 1) for i in range(11)) / sum(i + 1 for i in range(11))
    assert np.allclose(M.unpack_weights(M._averaged(df).tobytes())["b"], want, rtol=1e-5)


def test_rounds_train_on_every_document_once(spark, monkeypatch):
    seen, averaged = [], M._averaged
    monkeypatch.setattr(M, "_averaged", lambda w: seen.append(sum(r.n for r in w.select("n").collect())) or averaged(w))
    texts = ["a b c " * (k + 1) for k in range(30)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    hashes = np.array([M.word_hash(w) for w in (M.END, b"a", b"b", b"c")])
    monkeypatch.setattr(M, "GROUP_BYTES", 500)
    M.train(docs, hashes, M.start_weights(np.array([30, 465, 465, 465]), np.zeros(M.BUCKETS)), sum(map(len, texts)))
    assert len(seen) == M.ROUNDS and sum(seen) == sum(len(M.words(t)) for t in texts)


def test_words_of_the_head_are_told_apart():
    ws = [f"w{k}".encode() for k in range(2048)]
    symbols, _ = M.Vocabulary(np.array([M.word_hash(w) for w in ws])).symbols(np.arange(2048))
    assert len(set(symbols.tolist())) == 2048 and M.EMBED >= 24 and M.HIDDEN >= 32


def test_partitions_do_not_change_scores(spark, sf, monkeypatch):
    monkeypatch.setattr(M, "GROUP_BYTES", 1 << 17)
    df = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    one, two = (dict(M.score_documents(df.repartition(n)).select("doc_id", "score").collect()) for n in (1, 7))
    assert one.keys() == two.keys() and all(abs(one[k] - two[k]) <= 1e-4 * abs(one[k]) for k in one)


def test_pieces_of_a_document_follow_one_another():
    ids, fresh = np.array([[5, 7], [6, 8]]), np.array([[True, True], [False, False]])
    assert M.inputs(ids, fresh, np.array([1, 6])).tolist() == [[1, 6], [5, 7]]


def test_texts_are_made_into_words_for_counts_and_once_more(spark, sf, monkeypatch):
    """Training and scoring read symbols; each made words of all texts anew before."""
    read, save = {}, M.save

    def kept(df, name):
        read[name] = "text#" in df._jdf.queryExecution().optimizedPlan().toString()
        return save(df, name)

    monkeypatch.setattr(M, "save", kept)
    assert M.score_documents(spark.read.parquet(f"{sf}/documents.parquet")).count() > 0
    assert {k for k, v in read.items() if v} == {"counts", "coded"} and {"dealt", "weights", "scored"} <= read.keys()


def test_logits_out_of_range_are_scaled(monkeypatch):
    p = small(monkeypatch)
    p = {k: x.astype(np.float32) for k, x in p.items()}
    hs, target = np.random.default_rng(5).standard_normal((40, 5)).astype(np.float32), np.arange(40) % 10
    want = M.log_probs(p, hs, target)
    for shift in (300, -300):
        far = p | {"cb": p["cb"] + np.float32(shift), "ob": p["ob"] + np.float32(shift)}
        assert np.allclose(M.log_probs(far, hs, target), want, atol=1e-3)


def test_words_of_a_batch_are_each_looked_at_once(monkeypatch):
    """A word of many texts was hashed or looked up again for each token of each text before."""
    rng, hashed, digest = np.random.default_rng(7), [], M.xxhash.xxh3_64_intdigest
    odd = ["".join(rng.choice(list(" \t\n\x0b\x0c\r\x1c\x1f\x00aAzZÄß　\x85漢😀"), n)) for n in rng.integers(0, 40, 300)]
    texts = [None, "", " ", "\n", "  lead", "trail\r\n", "A\x0bB", *odd, *["the same Words the"] * 50]
    want = [slow_words(t) for t in texts]
    M.word_hash(M.END)
    monkeypatch.setattr(M.xxhash, "xxh3_64_intdigest", lambda w: hashed.append(w) or digest(w))
    for a in (pa.array(texts), pa.array(["zz", *texts]).slice(1), pa.array(texts, pa.large_string())):
        hashed.clear()
        size, at, h = M.coded_words(a)
        assert len(hashed) == len(set(hashed)) == len({w for ws in want for w in ws})
        assert size.tolist() == [len(ws) for ws in want] and h[at].tolist() == [M.word_hash(w) for ws in want for w in ws]


def test_counts_are_whole_when_few_words_are_held(spark, monkeypatch):
    monkeypatch.setattr(M, "REMEMBERED", 5)
    monkeypatch.setattr("weirflow.llm.common.ARROW_ROWS", 2)
    M.session(spark)
    try:
        texts = [None, "", *[f"a b{k % 9} c{k} A" for k in range(40)]]
        got = dict(map(tuple, M.count_words(spark.createDataFrame([(t,) for t in texts], "text string")).collect()))
    finally:
        monkeypatch.undo()
        M.session(spark)
    assert got == {M.word_hash(w): n for w, n in Counter(w for t in texts for w in slow_words(t)).items()}
