"""SimHash near-duplicates at a similarity that short fingerprints are too coarse for.

The same method as in `simhash`, with wider fingerprints: texts of Jaccard similarity s have shingle vectors of cosine about
2s / (1 + s), so any bit of their fingerprints is the same with a probability p. The fingerprint is split into blocks as wide as the
number of texts asks for, and is as wide as it takes for a pair at the threshold to share a block but for MISSED of the cases. Pairs
that share a block are verified by the Hamming distance of 64 further bits, and then by the shingles themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirflow.llm.common import components, save, session

NGRAM, SIMILARITY = 5, 0.8
#: Share of the pairs at the threshold that share no block.
MISSED = 0.01
#: Least bits of a block.
LEAST_BITS = 12
#: Bits of 64 that a pair may differ in: at similarity 0.8 that are 9.7, with a deviation of 2.9; of unlike texts 32.
DISTANCE = 20
#: Of a block value shared by up to so many texts all pairs are compared at once; of others first each with a leader.
SHORT_RUN = 16
#: Pairs that a task sends at once, and shingles whose bits are counted at once, in bytes.
SENT, COUNTED = 1 << 16, 255
#: Classes that are broadcast to pick their texts, 8 bytes each; more are joined by shuffle.
BROADCAST = 1_000_000

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, ngram: int = NGRAM) -> np.ndarray:
    """The distinct shingles of one text as sorted hashes. A text of fewer words has one, of all of them; one without words none."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    n = min(ngram, len(h))
    if not n:
        return h
    out = np.zeros(len(h) - n + 1, dtype=np.uint64)
    for i in range(n):
        out = (out + h[i : i + len(out)]) * _ODD
    return np.unique(_mixed(out))


def shape(texts: int, similarity: float = SIMILARITY) -> tuple[int, int]:
    """(bits of a block, blocks) for so many texts: unlike ones share a block's value with few others, and a pair at the threshold
    shares some block but for MISSED of the cases."""
    bits = max(LEAST_BITS, int(np.ceil(np.log2(max(2, texts)))))
    once = (1 - np.arccos(2 * similarity / (1 + similarity)) / np.pi) ** bits
    return bits, int(np.ceil(np.log(MISSED) / np.log1p(-once)))


def fingerprint_bits(s: np.ndarray, width: int) -> np.ndarray:
    """`width` bits of a set of shingles, each set if it is in over half the shingles' hashes."""
    n = -(-width // 64)
    rng = np.random.default_rng(7)
    flip = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    ones = np.zeros(64 * n, dtype=np.int64)
    for k in range(0, len(s), COUNTED):
        part = _mixed((s[k : k + COUNTED, None] ^ flip) * _ODD)
        ones += np.unpackbits(part.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return (2 * ones > len(s))[:width]


def block_values(s: np.ndarray, bits: int, blocks: int) -> tuple[int, np.ndarray]:
    """(64 bits to verify with, the value of each block) of a set of shingles."""
    got = fingerprint_bits(s, 64 + bits * blocks)
    value = got[64:].reshape(blocks, bits) @ (1 << np.arange(bits, dtype=np.int64))
    return int(np.packbits(got[:64], bitorder="little").view("<i8")[0]), value


def similarity_of(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _pairs(rows: DataFrame, whole: bool) -> DataFrame:
    """rows: (key, c, print), with root if whole. Pairs (a, b) of unlike root that share a key and whose prints are near: all of them if
    whole; else, of runs longer than SHORT_RUN, each text with a leader, another one for each key, and with the next, and all of
    the run as rows (key, c, print), which in pairs is null."""

    def near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.bitwise_count(x ^ y) <= DISTANCE

    def of_long(key: int, c: np.ndarray, p: np.ndarray, root: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if whole:
            for i in range(len(c) - 1):
                ok = (root[i + 1 :] != root[i]) & near(p[i + 1 :], p[i])
                if ok.any():
                    yield np.full(ok.sum(), c[i]), c[i + 1 :][ok]
            return
        order = np.argsort(_mixed(c.view(np.uint64) ^ np.uint64(key & (1 << 64) - 1)))
        c, p = c[order], p[order]
        ok = near(p[1:], p[0])
        yield np.full(ok.sum(), c[0]), c[1:][ok]
        ok = near(p[1:], p[:-1])
        yield c[:-1][ok], c[1:][ok]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def cut(k: np.ndarray, c: np.ndarray, p: np.ndarray, r: np.ndarray) -> Iterator[pa.RecordBatch]:
            p = p.view(np.uint64)
            start = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            size = np.diff(np.r_[start, len(k)])
            left, right, sent = [], [], 0

            def batch() -> pa.RecordBatch:
                a, b = np.concatenate(left), np.concatenate(right)
                return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.nulls(len(a), pa.int64())], ["a", "b", "print"])

            per_row = np.repeat(size, size)
            short = np.flatnonzero((per_row > 1) & (per_row <= SHORT_RUN))
            sk, sc, sp, sr = k[short], c[short], p[short], r[short]
            for d in range(1, SHORT_RUN):
                if len(sk) <= d:
                    break
                hit = np.flatnonzero((sk[d:] == sk[:-d]) & (sr[d:] != sr[:-d]) & near(sp[d:], sp[:-d]))
                left.append(sc[hit])
                right.append(sc[hit + d])
            if left:
                yield batch()
                left, right = [], []
            long = np.flatnonzero(size > SHORT_RUN)
            for s, n in zip(start[long].tolist(), size[long].tolist(), strict=True):
                if (r[s : s + n] == r[s]).all():
                    continue
                for x, y in of_long(int(k[s]), c[s : s + n], p[s : s + n], r[s : s + n]):
                    left.append(x)
                    right.append(y)
                    sent += len(x)
                    if sent >= SENT:
                        yield batch()
                        left, right, sent = [], [], 0
            if left:
                yield batch()
            if len(long) and not whole:
                rest = per_row > SHORT_RUN
                yield pa.RecordBatch.from_arrays([pa.array(x[rest].view(np.int64)) for x in (k, c, p)], ["a", "b", "print"])

        held = [np.empty(0, dtype=np.int64)] * 4
        for b in batches:
            columns = b.columns if whole else [*b.columns, b.column(1)]  # at first each class is its own root
            held = [np.concatenate([x, y.to_numpy(zero_copy_only=False)]) for x, y in zip(held, columns, strict=True)]
            if len(held[0]) < SENT:
                continue
            at = int(np.searchsorted(held[0], held[0][-1]))  # the last run may go on in the next batch
            if at:
                yield from cut(*(x[:at] for x in held))
                held = [x[at:] for x in held]
        if len(held[0]):
            yield from cut(*held)

    out = rows.select("key", "c", "print", *["root"] * whole).repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long, print long")
    return out.distinct()


def _verified(pairs: DataFrame, texts: DataFrame, ngram: int, similarity: float) -> DataFrame:
    """Those of pairs (a, b) whose texts (c, text) have at least that similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, one = None, None
        for b in batches:
            hit = []
            for x, y in zip(b.column(0).to_pylist(), zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True), strict=True):
                if x != last:
                    last, one = x, shingles(y[0], ngram)
                hit.append(similarity_of(one, shingles(y[1], ngram)) >= similarity)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(hit, pa.bool_()))

    pairs = save(pairs, "pairs")
    ends = save(pairs.select(F.col("a").alias("c")).union(pairs.select("b")).distinct(), "ends")
    text = save(texts.join(F.broadcast(ends) if ends.count() <= BROADCAST else ends, "c", "left_semi").dropDuplicates(["c"]), "texts")
    one, two = text.select(F.col("c").alias("a"), F.col("text").alias("x")), text.select(F.col("c").alias("b"), F.col("text").alias("y"))
    return save(pairs.join(two, "b").join(one, "a").select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "verified")


def _rooted(df: DataFrame, id_col: str, text_col: str, ngram: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(rows of df as (row, id, c, rest), the root of each class c). rest holds all columns; row is a number of the row's own."""
    session(df.sparkSession)
    bits, blocks = shape(df.count(), similarity)
    given = df.select(F.col(id_col).cast("long").alias("id"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("rest"))
    names, at = ["row", "id", "c", "print", "blocks", "rest"], df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for b in batches:
            sets = [shingles(x, ngram) for x in b.column(1).field(at).to_pylist()]
            c = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], dtype=np.uint64).view(np.int64)
            got = [block_values(s, bits, blocks) if len(s) else (0, []) for s in sets]
            cols = [pa.array(row + np.arange(len(sets))), b.column(0), pa.array(c), pa.array([x for x, _ in got], pa.int64()), pa.array([x for _, x in got], pa.list_(value)), b.column(1)]
            yield pa.RecordBatch.from_arrays(cols, names)
            row += len(sets)

    # Values are sent as short as they are: blocks have few bits, and each doubles what there is to compare.
    value, kind = (pa.int32(), T.IntegerType()) if bits < 32 else (pa.int64(), T.LongType())
    kinds = (T.LongType(), T.LongType(), T.LongType(), T.LongType(), T.ArrayType(kind), given.schema["rest"].dataType)
    prints = save(given.mapInArrow(run, T.StructType([T.StructField(n, k) for n, k in zip(names, kinds, strict=True)])), "prints")
    key = F.col("block").cast("long") * (1 << min(56, bits)) + F.col("value") if bits <= 50 else F.xxhash64("block", "value")
    rows = prints.select("c", "print", "blocks").dropDuplicates(["c"]).select("c", "print", F.posexplode("blocks").alias("block", "value")).select(key.alias("key"), "c", "print")
    found = save(_pairs(rows, whole=False), "found")
    texts = prints.select("c", F.col("rest").getField(text_col).alias("text"))
    links = _verified(found.where("print is null").select("a", "b"), texts, ngram, similarity)
    comp = components(links)
    long_rows = found.where("print is not null").select(F.col("a").alias("key"), F.col("b").alias("c"), "print")
    if not long_rows.isEmpty():
        # What the leaders have joined needs no further links; all other pairs of long runs are compared as well.
        left = long_rows.join(comp.withColumnRenamed("node", "c"), "c", "left").select("key", "c", "print", F.coalesce("root", "c").alias("root"))
        comp = components(links.union(_verified(_pairs(left, whole=True).select("a", "b"), texts, ngram, similarity)))
    classes = prints.select("c").distinct().join(comp.withColumnRenamed("node", "c"), "c", "left")
    return prints, save(classes.select("c", F.coalesce("root", "c").alias("root")), "rooted")


def near_copy_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = NGRAM, similarity: float = SIMILARITY) -> DataFrame:
    """Groups of documents whose sets of word shingles have a Jaccard similarity of at least `similarity`.

    Returns one row per row of df: (id_col long, component_id long: the smallest id that links reach). Texts of equal
    shingles are one class; classes that share a block of their fingerprints are compared by 64 bits and then by their whole sets of
    shingles. Texts without words are copies of each other; a null id takes part but never names a component unless all its ids
    are null; repeated rows give repeated results. Texts are read whole; other columns are ignored; an empty table gives no rows.
    """
    prints, rooted = _rooted(df, id_col, text_col, ngram, similarity)
    least = prints.groupBy("c").agg(F.min("id").alias("least")).join(rooted, "c").groupBy("root").agg(F.min("least").alias("component_id"))
    named = save(rooted.join(least, "root").select("c", "component_id"), "named")
    return prints.select("id", "c").join(named, "c").select(F.col("id").alias(id_col), "component_id")


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = NGRAM, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of df of which one of each group of near copies (near_copy_groups) stays: the one of the least id, nulls last; of rows
    that repeat that id some one. All columns stay as they are; an empty table gives no rows."""
    prints, rooted = _rooted(df, id_col, text_col, ngram, similarity)
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "row")
    first = prints.groupBy("c").agg(F.min(place).alias("p")).join(rooted, "c").groupBy("root").agg(F.min("p").alias("p")).select("p.row")
    # The same plan at every size: small tables would be broadcast, and figures taken from them wouldn't hold for large ones.
    kept = prints.join(save(first, "first").hint("merge"), "row", "left_semi")
    return kept.select(*[F.col("rest").getField(c).alias(c) for c in df.columns])
