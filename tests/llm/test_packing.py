import random
import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from weirflow.llm import packing as P


def test_round_trip(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    extra = [(10_001, None), (10_002, ""), (10_003, "  two\n\nLines É́ <|endoftext|>x 12,5"), (10_004, "word " * 30_000), (None, "no id")]
    df = docs.union(spark.createDataFrame(extra, "doc_id long, text string")).selectExpr("*", "1 as start", "'x' as offset")
    rows = P.pack_documents(df).collect()
    tok = Tokenizer.from_file(P.default_tokenizer())
    ids = {r.doc_id: [*tok.encode(r.text or "", add_special_tokens=False).ids, 1] for r in df.collect()}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], dtype="<u4")
        assert len(part) == r.length > 0 and zlib.crc32(part.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        by_doc[r.doc_id].append((r.start, r.length))
        by_seq[r.sequence_id].append((r.offset, r.length, r.window))
    assert by_doc.keys() == ids.keys()
    for d, ps in by_doc.items():
        at = 0
        for s, n in sorted(ps):
            assert s == at
            at += n
        assert at == len(ids[d])
    for ps in by_seq.values():
        at = 0
        for o, n, _ in sorted(ps):
            assert o == at
            at += n
        assert at == ps[0][2] <= 2048 and at & (at - 1) == 0
    steps = defaultdict(int)
    for s in {r.sequence_id: r for r in rows}.values():
        steps[s.step_group] += s.window
    assert max(steps.values()) < P.STEP_TOKENS + 2048


def test_pack_cuts_little_and_fills_every_window():
    rnd = random.Random(1)
    docs = [(k, 0, rnd.choice([1, 30, 300, 700, 1500, 5000]) + rnd.randrange(50)) for k in range(500)]
    windows, rest = P.pack(docs)
    assert not rest and all(sum(p[2] for p in ps) == n for n, ps in windows)
    assert sum(n for n, _ in windows) == sum(d[2] for d in docs)
    windows, rest = P.pack(docs, final=False)
    assert sum(n for n, _ in windows) + sum(p[2] for p in rest) == sum(d[2] for d in docs) and sum(p[2] for p in rest) < 256


def test_empty(spark):
    assert P.pack_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_forgetting_chunks_keeps_ids_right(monkeypatch):
    monkeypatch.setattr(P, "REMEMBERED", 3)
    ids, tok = P.Ids(P.default_tokenizer()), Tokenizer.from_file(P.default_tokenizer())
    for t in ["one two three four", "one five, don't", "five one six\nseven", "two"]:
        assert ids.of([t, "one", None], b"") == [np.array(tok.encode(x, add_special_tokens=False).ids, dtype="<u4").tobytes() for x in (t, "one", "")]
