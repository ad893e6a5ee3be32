"""Removal of repeated byte strings by longest-previous-factor arrays over suffix order.

A byte goes if a string of `length` bytes that covers it also starts earlier, so a position's longest previous factor
matters only up to `length`: suffixes are put in the order of their first `length` bytes, the previous and the next
smaller position in that order hold the longest earlier match, and a position whose factor is `length` bytes long is a copy.

All suffixes of a corpus don't fit a task. Every string of `length` bytes picks an anchor among its own GRAM-byte
strings (the one of least hash, the first of equals), which depends on nothing but the string. Windows that follow one
another and pick the same anchor form a context. Equal contexts hold equal windows, so of those all but the first are
copies as a whole (told by the anchor's and the context's hash, 128 bits together); what differs is where repeats begin and
end. Only there, for contexts that share an anchor but aren't equal, are the bytes themselves brought together and put in
suffix order. A group too large for one task is halved by the place of the anchor in the window: the windows of a half
have more bytes in common than the anchor, and equal windows agree in them, so they are the key of smaller groups, down to
single windows if need be. No window is compared in any other way, and rows grow with the contexts, not with their pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.llm.common import keyed, save, session, table, tidy

LENGTH, GRAM = 100, 32
#: Bytes of text that a task scans at once (a longer text is scanned in parts that overlap by LENGTH - 1 bytes).
SCAN = 1 << 20
#: Bytes of contexts that are put in suffix order at once; an anchor's contexts stay together.
ORDERED = 1 << 20
#: Unequal contexts of one key that are put in suffix order together; the windows of a larger group are keyed on more bytes.
GROUP = 4096
U = np.uint64


def _mix(h: np.ndarray) -> np.ndarray:
    return (h ^ (h >> U(29))) * U(0xBF58476D1CE4E5B9)


def _gram_hashes(b: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each position."""
    h, n = _mix((b.astype(U) + U(1)) * U(0x9E3779B97F4A7C15)), 1
    while n < GRAM:
        h = _mix(h[:-n] * U(0x9E3779B97F4A7C15) + h[n:] * U(0xC2B2AE3D27D4EB4F))
        n *= 2
    return h


def contexts(b: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, position of the anchor, first window, end of windows) of each run of windows of b that pick one anchor."""
    h = _gram_hashes(b)
    least = (h & U(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=U)
    n, width = 1, length - GRAM + 1
    while 2 * n <= width:
        least = np.minimum(least[:-n], least[n:])
        n *= 2
    if width > n:
        least = np.minimum(least[: n - width], least[width - n :])
    at = (least & U(0xFFFFFFFF)).astype(np.int64)
    lo = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return h, at, lo, np.r_[lo[1:], len(at)]


def suffix_ranks(t: np.ndarray, depth: int) -> list[tuple[int, np.ndarray]]:
    """(width, ranks of the suffixes of t in the order of their first `width` bytes) for widths that double up to `depth`; equal
    prefixes have equal ranks."""
    pad = np.zeros(len(t) + depth, dtype=np.uint8)
    pad[: len(t)] = t
    width, r = min(8, depth), np.zeros(len(t) + depth - 7, dtype=U)
    for k in range(width):
        r = (r << U(8)) | pad[k : len(r) + k]
    r = np.unique(r, return_inverse=True)[1].astype(U)
    out = [(width, r)]
    while width < depth:
        step = min(width, depth - width)
        r = np.unique(r[:-step] * U(len(pad) + 1) + r[step:], return_inverse=True)[1].astype(U)
        width += step
        out.append((width, r))
    return out


def previous_smaller(x: np.ndarray) -> np.ndarray:
    """For each place of x the nearest place before it with a smaller value, -1 for none: whoever points at a larger value takes
    over that one's pointer, which halves the chains each time."""
    at = np.arange(-1, len(x) - 1)
    todo = np.arange(len(x))
    while len(todo):
        p = at[todo]
        todo = todo[(p >= 0) & (x[p] > x[todo])]
        at[todo] = at[at[todo]]
    return at


def common_prefix(ranks: list[tuple[int, np.ndarray]], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Bytes that the suffixes at i and j have in common, in steps of the least width, up to the largest."""
    depth, whole = ranks[-1]
    size = np.where(whole[i] == whole[j], depth, 0)
    left = np.flatnonzero(size == 0)
    for width, r in ranks[-2::-1]:
        a, b = i[left] + size[left], j[left] + size[left]
        ok = np.maximum(a, b) < len(r)
        ok[ok] = r[a[ok]] == r[b[ok]]
        size[left] += width * ok
    return size


def longest_previous(t: np.ndarray, starts: np.ndarray, place: np.ndarray, depth: int) -> np.ndarray:
    """The longest previous factor, up to `depth` bytes, of the suffixes of t at `starts`: what each has in common with one of
    less `place` (distinct numbers). Of all those the longest match is the previous or the next smaller place in suffix order."""
    ranks = suffix_ranks(t, depth)
    order = np.lexsort((place, ranks[-1][1][starts]))
    s, p, n = starts[order], place[order], len(starts)
    before, after = previous_smaller(p), n - 1 - previous_smaller(p[::-1])[::-1]
    factor = np.zeros(n, dtype=np.int64)
    for near, some in ((before, before >= 0), (after, after < n)):
        factor[some] = np.maximum(factor[some], common_prefix(ranks, s[some], s[near[some]]))
    out = np.empty(n, dtype=np.int64)
    out[order] = factor
    return out


MARK = "anchor long, ctx long, doc long, tie long, lo long, n int"
MARK_NAMES = [x.split()[0] for x in MARK.split(", ")]


def _marks(docs: DataFrame, length: int) -> DataFrame:
    """Contexts of all texts. Of equal contexts that a task scans together only the first goes on by its anchor; the others are
    known to be copies and have n < 0."""

    def one(texts: list[tuple[int, int, int, bytes]]) -> Iterator[pa.RecordBatch]:
        b = np.frombuffer(b"".join(x[3] for x in texts), dtype=np.uint8)
        if len(b) < length:
            return
        size = np.array([len(x[3]) for x in texts])
        end = np.cumsum(size)
        h, at, _, _ = contexts(b, length)
        s = np.arange(len(at))
        owner = np.repeat(np.arange(len(texts)), size)[: len(at)]
        ok = s + length <= end[owner]
        lo = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (owner[1:] != owner[:-1]) | (ok[1:] != ok[:-1])])
        hi = np.r_[lo[1:], len(at)]
        lo, hi = lo[ok[lo]], hi[ok[lo]]
        if not len(lo):
            return
        raw, digest = b.tobytes(), xxhash.xxh3_64_intdigest
        ctx = np.array([digest(raw[x : y + length - 1]) for x, y in zip(lo.tolist(), hi.tolist(), strict=True)], dtype=U).view(np.int64)
        o = owner[lo]
        doc, tie, base = (np.array([x[k] for x in texts], dtype=np.int64)[o] for k in (0, 1, 2))
        place = base + lo - (end - size)[o]
        order = np.lexsort((place, tie, doc, ctx))
        new = np.r_[True, np.diff(ctx[order]) != 0]
        copy = np.zeros(len(lo), dtype=bool)
        copy[order] = ~new
        anchor = h[at[lo]].view(np.int64)
        anchor = np.where(copy, _mix(place.view(U) + _mix(doc.view(U))).view(np.int64), anchor)
        n = np.where(copy, lo - hi, hi - lo).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (anchor, ctx, doc, tie, place, n)], MARK_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for doc, tie, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for k in range(0, max(1, len(data) - length + 1), SCAN):
                    part = data[k : k + SCAN + length - 1]
                    if len(part) >= length:
                        held.append((doc, tie, k, part))
                        size += len(part)
                    if size >= SCAN:
                        yield from one(held)
                        held, size = [], 0
        if held:
            yield from one(held)

    return docs.mapInArrow(run, MARK)


def _sift(marks: DataFrame) -> DataFrame:
    """marks by anchor -> rows (kind, anchor, doc, tie, lo, n). kind 0: windows that are copies as a whole; 1: first contexts
    whose anchor has other contexts as well; 2: the same where they are more than GROUP."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, dtype=np.int64) for _ in MARK_NAMES]

        def rows(kind: np.ndarray, cols: list[np.ndarray]) -> pa.RecordBatch:
            anchor, _, doc, tie, lo, n = cols
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (kind.astype(np.int32), anchor, doc, tie, lo, np.abs(n).astype(np.int32))], ["kind", "anchor", "doc", "tie", "lo", "n"])

        def out(cols: list[np.ndarray], last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held
            known = cols[5] < 0
            if known.any():
                yield rows(np.zeros(known.sum()), [c[known] for c in cols])
                cols = [c[~known] for c in cols]
            anchor, ctx, doc, tie, lo, _ = cols
            if not len(anchor):
                held = cols
                return
            new_a = np.r_[True, anchor[1:] != anchor[:-1]]
            new = new_a | np.r_[True, ctx[1:] != ctx[:-1]]
            first = np.flatnonzero(new)[np.cumsum(new) - 1]
            copy = (doc != doc[first]) | (tie != tie[first]) | (lo != lo[first])
            if copy.any():
                yield rows(np.zeros(copy.sum()), [c[copy] for c in cols])
            firsts = [c[new] for c in cols]
            a = firsts[0]
            start = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
            if not last:
                held, firsts = [c[start[-1] :] for c in firsts], [c[: start[-1]] for c in firsts]
                start = start[:-1]
            if len(start):
                count = np.repeat(x := np.diff(np.r_[start, len(firsts[0])]), x)
                many = count > 1
                if many.any():
                    yield rows(1 + (count[many] > GROUP), [c[many] for c in firsts])

        for batch in batches:
            cols = [np.concatenate([x, c.to_numpy(zero_copy_only=False)]) for x, c in zip(held, batch.columns, strict=True)]
            yield from out(cols, False)
        if len(held[0]):
            yield from out(held, True)

    return marks.repartition("anchor").sortWithinPartitions("anchor", "ctx", "doc", "tie", "lo").mapInArrow(run, "kind int, anchor long, doc long, tie long, lo long, n int")


def _texts(docs: DataFrame, marks: DataFrame, length: int) -> DataFrame:
    """The bytes of marked contexts: (kind, anchor, doc, tie, lo, n, data)."""
    want = marks.where("kind > 0").groupBy("doc", "tie").agg(F.collect_list(F.struct("kind", "anchor", "lo", "n")).alias("marks"))
    m = F.col("m")
    return (
        docs.join(want, ["doc", "tie"])
        .select("doc", "tie", "data", F.explode("marks").alias("m"))
        .select(m["kind"].alias("kind"), m["anchor"].alias("anchor"), "doc", "tie", m["lo"].alias("lo"), m["n"].alias("n"), F.substring("data", m["lo"].cast("int") + 1, m["n"] + (length - 1)).alias("data"))
    )


SPAN = "doc long, tie long, lo long, hi long"


def _spans(doc: np.ndarray, tie: np.ndarray, s: np.ndarray, length: int) -> pa.RecordBatch:
    """Removed windows, in order of (doc, tie, s) or in runs of it, as spans of bytes."""
    new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1]) | (s[1:] != s[:-1] + 1)])
    last = np.r_[new[1:], len(s)] - 1
    return pa.RecordBatch.from_arrays([pa.array(doc[new]), pa.array(tie[new]), pa.array(s[new]), pa.array(s[last] + length)], ["doc", "tie", "lo", "hi"])


def _ordered(rows: DataFrame, length: int) -> DataFrame:
    """Spans that are copies, of contexts (key, doc, tie, lo, n, data), by the longest previous factors among those of one key."""

    def one(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        doc, tie, lo, n = (np.array([x[k] for x in held], dtype=np.int64) for k in range(1, 5))
        size = n + length - 1
        start = np.cumsum(size) - size
        which = np.repeat(np.arange(len(held)), n)
        step = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        d, t, s = doc[which], tie[which], lo[which] + step
        # Contexts of several keys share the array; an equal string elsewhere has picked the same anchor, so has the same key.
        place = np.empty(len(which), dtype=np.int64)
        place[np.lexsort((s, t, d))] = np.arange(len(which))
        text = np.frombuffer(b"".join(x[5] for x in held), dtype=np.uint8)
        gone = longest_previous(text, start[which] + step, place, length) >= length
        if gone.any():
            yield _spans(d[gone], t[gone], s[gone], length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= ORDERED and x[0] != held[-1][0]:
                    yield from one(held)
                    held, size = [], 0
                held.append(x)
                size += len(x[5])
        if held:
            yield from one(held)

    return rows.select("key", "doc", "tie", "lo", "n", "data").repartition("key").sortWithinPartitions("key").mapInArrow(run, SPAN)


HALF = "key long, hull long, side int, at int, doc long, tie long, lo long, n int, data binary"
HALF_NAMES = [x.split()[0] for x in HALF.split(", ")]


def _halved(rows: DataFrame, length: int, bounds: list[tuple[int, int]]) -> DataFrame:
    """Contexts (side, at, doc, tie, lo, n, data) cut in two by how many bytes stand before the anchor; the windows of side k have
    bounds[k][0] to bounds[k][1] of them. The key is what all windows of a half have in common, hull what they are made of; at:
    the anchor's place in data. Of equal halves that a task reads together only the first goes on, the others, known to be copies,
    have n < 0 and no data."""

    def one(held: list[tuple]) -> pa.RecordBatch:
        place = [x[1] for x in held]
        if None in place:  # contexts as the scan has found them
            size = np.array([len(x[6]) for x in held])
            _, at, _, _ = contexts(np.frombuffer(b"".join(x[6] for x in held), dtype=np.uint8), length)
            first = np.cumsum(size) - size
            place = (at[first] - first).tolist()
        digest, best, out = xxhash.xxh3_64_intdigest, {}, []
        for (side, _, doc, tie, lo, n, data), at in zip(held, place, strict=True):
            low, high = bounds[side]
            mid = (low + high) // 2
            for k, a, b in ((0, low, mid), (1, mid + 1, high)):
                most, least = min(b, at), max(a, at - n + 1)
                if most < least:
                    continue
                shift, m = at - most, most - least + 1
                part = data[shift : shift + m + length - 1]
                key = digest(data[at - a : at - b + length], 2 * side + k)
                row = (key, digest(part, 1 + 128 * most + m), 2 * side + k, most, doc, tie, lo + shift, m, part)
                seen = best.get(row[:2])
                if seen is None:
                    best[row[:2]] = len(out)
                    out.append(row)
                elif row[4:7] < out[seen][4:7]:
                    out[seen], row = row, out[seen]
                    out.append((*row[:7], -row[7], None))
                else:
                    out.append((*row[:7], -row[7], None))
        signed = lambda c: np.array(c, dtype=U).view(np.int64)
        cols = list(zip(*out, strict=True)) if out else [[]] * 9
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(signed(c) if i < 2 else c, k) for i, (c, k) in enumerate(zip(cols, kinds, strict=True))], HALF_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            held += zip(*(c.to_pylist() for c in batch.columns), strict=True)
            if len(held) >= 4096:
                yield one(held)
                held = []
        if held:
            yield one(held)

    return rows.select("side", "at", "doc", "tie", "lo", "n", "data").mapInArrow(run, HALF)


def _split(hot: DataFrame, length: int) -> list[DataFrame]:
    """Spans that are copies, of contexts whose anchor has more than GROUP of them."""
    spans, rows, bounds = [], hot.select(F.lit(0).alias("side"), F.lit(None).cast("int").alias("at"), "doc", "tie", "lo", "n", "data"), [(0, length - GRAM)]
    while not rows.isEmpty():
        got = save(_halved(rows, length, bounds), "halves")
        bounds = [x for a, b in bounds for x in ((a, (a + b) // 2), ((a + b) // 2 + 1, b))]
        known = got.where("n < 0").select("doc", "tie", "lo", (F.col("lo") - F.col("n") + (length - 1)).alias("hi"))
        whole = F.struct("doc", "tie", "lo")
        # Equal halves meet here by their hash, one of each task.
        firsts = got.where("n > 0").groupBy("key", "hull").agg(F.min(whole).alias("first"), F.count("*").alias("c"))
        copies = got.where("n > 0").drop("data").join(firsts.where("c > 1"), ["key", "hull"]).where(whole != F.col("first"))
        spans += [known, copies.select("doc", "tie", "lo", (F.col("lo") + F.col("n") + (length - 1)).alias("hi"))]
        sizes = firsts.groupBy("key").agg(F.count("*").alias("groups")).where("groups > 1")
        alone = got.where("n > 0").join(firsts.select("key", "hull", "first"), ["key", "hull"]).where(whole == F.col("first")).drop("hull", "first")
        left = save(alone.join(sizes, "key"), "groups")
        spans.append(_ordered(left.where(F.col("groups") <= GROUP), length))
        rows = left.where(F.col("groups") > GROUP)
    return spans


def kept_ranges(spans: list[tuple[int, int]], size: int) -> tuple[int, int, list[tuple[int, int]]]:
    """(bytes removed, maximal removed runs, ranges that stay) of spans in any order."""
    removed = runs = at = 0
    keep, end = [], -1
    for lo, hi in sorted(spans):
        if lo > end:
            runs += 1
            keep.append((at, lo))
            removed += hi - lo
            end = hi
        elif hi > end:
            removed += hi - end
            end = hi
        at = end
    keep.append((at, size))
    return removed, runs, [(a, b) for a, b in keep if b > a]


def drop_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, with_text: bool = False) -> DataFrame:
    """Remove from each text every byte covered by a `length`-byte string that also starts earlier in the table.

    Earlier: a smaller id, or the same row and an earlier byte. Returns one row per row of df: id_col, n_bytes, n_removed,
    n_spans (maximal removed runs), kept_sha256, and kept_bytes (the bytes that stay) if with_text. Null texts count as
    empty; texts shorter than `length` stay whole; null ids come after all others. Where an id repeats, its texts are
    ordered by their hash, and equal rows are one text that shares its result. Extra columns are ignored; an empty table gives
    no rows. Texts of any length are scanned whole, in overlapping parts.
    """
    if length < GRAM:
        raise ValueError(f"length must be at least {GRAM}")
    spark = session(df.sparkSession)
    docs, unique = keyed(df, id_col, text_col)
    marks = save(_sift(_marks(unique, length)), "marks")
    tidy(spark)
    texts = save(_texts(unique, marks, length), "contexts")
    tidy(spark)
    whole = marks.where("kind = 0").select("doc", "tie", "lo", (F.col("lo") + F.col("n") + (length - 1)).alias("hi"))
    spans = whole.union(_ordered(texts.where("kind = 1").withColumnRenamed("anchor", "key"), length))
    for more in _split(texts.where("kind = 2"), length):
        spans = spans.union(more)
    by_doc = save(spans.groupBy("doc", "tie").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")), "spans")
    tidy(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []] + [[]] * with_text
            for data, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                removed, runs, keep = kept_ranges([(x["lo"], x["hi"]) for x in spans or ()], len(data))
                kept = data if not runs else b"".join(data[a:b] for a, b in keep)
                for c, v in zip(out[1:], (len(data), removed, runs, hashlib.sha256(kept).hexdigest(), kept), strict=False):
                    c.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(out[1:], kinds, strict=False))], [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes"][: 5 + with_text])

    schema = f"`{id_col}` long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_bytes binary" * with_text
    return docs.join(by_doc, ["doc", "tie"], "left").select("id", "data", "spans").mapInArrow(run, schema)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """drop_repeats of the whole table `documents`."""
    return drop_repeats(table(spark, sf_dir, "documents"))
