import corpus_pipeline as C
from tests.llm.test_line_dedup import brute as line_brute
from tests.llm.test_simhash_wide import brute as copies_brute
from weirflow.llm import decontaminate as D
from weirflow.llm.common import save


def test_each_stage_on_its_own_input(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = spark.createDataFrame([(9000, None, "en", "s", 0), (9001, "", None, "s", 0), (9002, "... 12", "en", "s", 6), (9003, "the of and in to is", None, None, None)], docs.schema)
    docs = docs.union(extra)
    got = [docs]
    for name, stage in C.STAGES:
        got.append(save(stage(spark, got[-1], sf), name))
        if name != "packing":
            assert got[-1].columns == docs.columns and got[-1].dtypes == docs.dtypes
    text = [{r.doc_id: r.text for r in x.collect()} for x in got[:5]]
    assert text[1].keys() == text[0].keys() - {9000, 9001, 9002} and all(text[0][k] == v for k, v in text[1].items())
    assert text[2] == {d: t for d, t, *_ in line_brute(sorted(text[1].items()))}
    keep = {d for d, c in copies_brute(sorted(text[2].items())) if d == c}
    assert text[3] == {d: t for d, t in text[2].items() if d in keep}
    items = [D.words(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]

    def leaks(t):
        ws = D.words(t)
        return any(D.compare(w, ws[max(0, i - len(w)) : i + 32 + len(w)])[2] for w in items for i in range(0, max(1, len(ws) - 16), 16))

    leaked = {d for d, t in text[3].items() if leaks(t)}
    gone = text[3].keys() - text[4].keys()
    assert leaked and gone <= leaked and len(gone) >= 0.95 * len(leaked)
    assert {r.doc_id for r in got[5].collect()} == text[4].keys()


def test_run_and_empty(spark, sf, tmp_path):
    assert C.run(spark, sf).count() > 0
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("false")
    for _, stage in C.STAGES:
        out = stage(spark, docs, sf)
        assert out.count() == 0


def test_repeated_rows_ids_and_nulls(spark, sf):
    """Repeated rows, repeated and null ids, null columns: each stage has a defined result."""
    long = " ".join(f"the word{k} of and" for k in range(60))
    item = spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").first().text
    rows = [(1, long, "en", "s", 1)] * 3 + [(2, long + " more", None, None, None), (None, long, "en", "s", 1), (None, "quite another text here", "en", "s", 1), (None, None, None, None, None), (3, "x " + item, "en", "s", 1), (3, "the clean row of the same id", "en", "s", 1), (None, item, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted(((r.doc_id, r.text) for r in C.near_copies(spark, docs, sf).collect()), key=str)
    assert kept == sorted({(d, t) for d, t, *_ in rows if d == 3 or t is None or d == 1 or t.startswith("quite")}, key=str)  # the item alone is a near copy of row 3
    clean = sorted(((r.doc_id, r.text) for r in C.decontaminated(spark, docs, sf).collect()), key=str)
    assert clean == sorted(((d, t) for d, t, *_ in rows if not t or item not in t), key=str)
    lines = C.lines(spark, docs, sf)
    assert lines.count() == len(rows) and lines.columns == docs.columns
    assert C.language(spark, docs, sf).where("text is null").isEmpty()
    assert C.packed(spark, docs, sf).groupBy().sum("length").collect()[0][0] > len(rows)
