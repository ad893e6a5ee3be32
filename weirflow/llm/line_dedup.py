"""Fuzzy line deduplication by MinHash of character shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirflow.llm.common import components, keyed, save, session, table, tidy

SHINGLE, SIMILAR = 8, 0.8
#: Signatures are BANDS x ROWS minima: a pair of similarity 0.8 shares a band with probability 1 - (1 - 0.8^4)^12 = 0.998.
BANDS, ROWS = 12, 4
#: Lines that are compared in one task at most; an eighth of it are compared by search, more are cut.
RUN = 4096
#: Lines whose common shingles with all others are counted at once, lines from which a shingle is counted by matrices, and their cells.
AT_ONCE, OFTEN, CELLS = 1 << 10, 16, 1 << 24
#: Characters whose signatures are made at once; also those that small runs are put together to, to be compared at once.
CHUNK = 1 << 17
U = np.uint64


def shingle_hashes(codes: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """A hash of the k code points from each position (k a power of two)."""
    h, n = codes.astype(U) + U(1), 1
    while n < k:
        h = h[:-n] * U(0x9E3779B97F4A7C15) + h[n:] * U(0xC2B2AE3D27D4EB4F)
        h = (h ^ (h >> U(29))) * U(0xBF58476D1CE4E5B9)
        n *= 2
    return h ^ (h >> U(32))


def band_keys(lines: list[str], k: int = SHINGLE) -> np.ndarray:
    """By line, the hashes of its BANDS bands. A line shorter than k characters is one shingle, padded."""
    padded = [x if len(x) >= k else x + "\0" * (k - len(x)) for x in lines]
    size = np.array([len(x) for x in padded])
    h = shingle_hashes(np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), dtype=np.uint32), k)
    n = size - k + 1
    start = np.cumsum(size) - size
    first = np.cumsum(n) - n
    h = h[np.arange(n.sum()) + np.repeat(start - first, n)].astype(np.uint32)
    scale = (np.random.default_rng(7).integers(1, 1 << 31, BANDS * ROWS, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
    out, buf = np.empty((len(lines), BANDS), dtype=U), np.empty_like(h)
    for b in range(BANDS):
        key = np.full(len(lines), b + 1, dtype=U)
        for a in scale[b * ROWS : (b + 1) * ROWS]:
            np.multiply(h, a, out=buf)
            key = (key ^ np.minimum.reduceat(buf, first).astype(U)) * U(0x9E3779B97F4A7C15)
            key ^= key >> U(29)
        out[:, b] = key
    return out


def shingles(line: str, k: int = SHINGLE) -> set[str]:
    return {line[i : i + k] for i in range(max(1, len(line) - k + 1))}


def jaccard(a: str, b: str, k: int = SHINGLE) -> float:
    x, y = shingles(a, k), shingles(b, k)
    both = len(x & y)
    return both / (len(x) + len(y) - both)


def split_lines(data: bytes) -> list[bytes]:
    return data.split(b"\n")


def _digest(line: bytes) -> int:
    x = xxhash.xxh3_64_intdigest(line)
    return x - (1 << 64) if x >> 63 else x


def _occurrences(docs: DataFrame) -> DataFrame:
    """(h, doc, tie, no) of each line that isn't blank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for doc, tie, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for no, line in enumerate(split_lines(data)):
                    if line and not line.isspace():
                        for c, v in zip(out, (_digest(line), doc, tie, no), strict=True):
                            c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["h", "doc", "tie", "no"])

    return docs.mapInArrow(run, "h long, doc long, tie long, no long")


def _bands(docs: DataFrame) -> DataFrame:
    """(key, h): each band of each line; lines that a batch holds twice come once."""

    def one(lines: list[bytes]) -> pa.RecordBatch:
        keys = band_keys([x.decode("utf-8", "replace") for x in lines])
        h = np.repeat(np.array([_digest(x) for x in lines], dtype=np.int64), BANDS)
        return pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(h)], ["key", "h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, None] = {}
        size = 0
        for batch in batches:
            for data in batch.column(0).to_pylist():
                for line in split_lines(data):
                    if line and line not in held and not line.isspace():
                        held[line] = None
                        size += len(line)
                        if size >= CHUNK:
                            yield one(list(held))
                            held, size = {}, 0
        if held:
            yield one(list(held))

    return docs.select("data").mapInArrow(run, "key long, h long")


def _runs(bands: DataFrame) -> DataFrame:
    """(run, h): the lines of each run, two or more that share a band. A run is known by its lines, so that the same ones
    sharing several bands are one run."""

    def one(key: np.ndarray, h: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((h, key))
        key, h = key[order], h[order]
        new = np.r_[True, (key[1:] != key[:-1]) | (h[1:] != h[:-1])]
        key, h = key[new], h[new]
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[start, len(key)])
        mixed = (h.view(U) ^ (h.view(U) >> U(31))) * U(0xBF58476D1CE4E5B9)
        run = np.repeat(np.add.reduceat(mixed ^ (mixed >> U(29)), start) + size.astype(U), size)
        keep = np.repeat(size > 1, size)
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(run[keep].view(np.int64)), pa.array(h[keep])], ["run", "h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, h = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        for batch in batches:
            key = np.concatenate([key, batch.column(0).to_numpy(zero_copy_only=False)])
            h = np.concatenate([h, batch.column(1).to_numpy(zero_copy_only=False)])
            if len(key) < 65_536:
                continue
            ends = key == key[-1]
            if not ends.all():
                yield from one(key[~ends], h[~ends])
            key, h = key[ends], np.unique(h[ends])
            key = key[: len(h)]
        if len(key):
            yield from one(key, h)

    return bands.repartition("key").sortWithinPartitions("key").mapInArrow(run, "run long, h long")


def _texts(docs: DataFrame, want: DataFrame) -> DataFrame:
    """want: (h, doc, tie, no) -> (h, line)."""
    by_doc = want.groupBy("doc", "tie").agg(F.collect_list(F.struct("h", "no")).alias("lines"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], []]
            for data, lines in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                have = split_lines(data)
                for x in lines:
                    out[0].append(x["h"])
                    out[1].append(have[x["no"]].decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.string())], ["h", "line"])

    return docs.join(by_doc, ["doc", "tie"]).select("data", "lines").mapInArrow(run, "h long, line string")


def shingle_numbers(codes: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """By position, a number of the k code points from there on, equal where all of them are equal and only there (k a power of two)."""
    used = np.zeros(int(codes.max()) + 1, dtype=U)
    used[codes] = 1
    h, most, n = (np.cumsum(used) - U(1))[codes], int(used.sum()), 1
    while n < k:
        if most > 1 << 32:  # two numbers wouldn't fit 64 bits
            names, h = np.unique(h, return_inverse=True)
            h, most = h.astype(U), len(names)
        h, most, n = h[:-n] * U(most) + h[n:], most * most, 2 * n
    return h


def line_sets(lines: list[str], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(ids, sizes): the distinct shingles of each line as ascending numbers, one line's after the other's, and how many each has.
    A line shorter than k characters is one shingle, padded by what no text holds."""
    padded = [x.ljust(k, "\udfff") for x in lines]
    size = np.array([len(x) for x in padded])
    h = shingle_numbers(np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), dtype=np.uint32), k)
    n = size - k + 1
    first = np.cumsum(n) - n
    h = h[np.arange(n.sum()) + np.repeat(np.cumsum(size) - size - first, n)]
    order = np.argsort(h)
    ids = np.empty(len(h), dtype=np.int64)
    ids[order] = np.cumsum(np.r_[False, h[order[1:]] != h[order[:-1]]])
    key = np.repeat(np.arange(len(lines)) << 32, n) | ids
    key.sort()
    key = key[np.r_[True, key[1:] != key[:-1]]]
    return key & 0xFFFFFFFF, np.bincount(key >> 32, minlength=len(lines))


def spanning(lines: list[str], starts: list[int], similar: float, k: int = SHINGLE) -> list[tuple[int, int]]:
    """Links that connect what similar pairs connect within each piece; a piece reaches from its place in starts to the next one's.
    First all lines are compared with the first of their piece; where that leaves some, each step of the search compares one line
    with those that aren't reached yet. So a group that is alike takes few comparisons and no pairs are kept."""
    ids, size = line_sets(lines, k)
    begin = np.cumsum(size) - size
    head = np.repeat(np.array(starts), np.diff([*starts, len(lines)]))
    line = np.repeat(np.arange(len(lines)), size)
    key = head[line] << 32 | ids
    known = key[line == head[line]]
    found = known[np.minimum(np.searchsorted(known, key), len(known) - 1)] == key
    both = np.add.reduceat(found.astype(np.int64), begin)
    linked = both >= similar * (size + size[head] - both)
    mine = np.flatnonzero(linked & (head != np.arange(len(lines))))
    out = list(zip(head[mine].tolist(), mine.tolist(), strict=True))
    mark = np.zeros(int(ids.max()) + 1, dtype=np.int32)
    for s in np.unique(head[~linked]).tolist():
        piece = np.arange(s, np.searchsorted(head, s, "right"))
        queue, rest = piece[linked[piece]][1:].tolist(), piece[~linked[piece]]
        while len(rest):
            if not queue:
                queue, rest = [int(rest[0])], rest[1:]
                continue
            x = queue.pop()
            own, n = ids[begin[x] : begin[x] + size[x]], size[rest]
            fit = np.minimum(n, size[x]) >= similar * np.maximum(n, size[x])
            some, n = rest[fit], n[fit]
            if not len(some):
                continue
            mark[own] = 1
            first = np.cumsum(n) - n
            both = np.add.reduceat(mark[ids[np.arange(n.sum()) + np.repeat(begin[some] - first, n)]], first)
            mark[own] = 0
            near = both >= similar * (size[x] + n - both)
            hit = some[near].tolist()
            out += [(x, y) for y in hit]
            queue += hit
            fit[fit] = near
            rest = rest[~fit]
    return out


def places(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The n places from each begin on, one after the other."""
    return np.arange(n.sum()) + np.repeat(begin - (np.cumsum(n) - n), n)


def joining(lines: list[str], roots: list[int], similar: float) -> list[tuple[int, int]]:
    """Links (of roots) that connect what similar pairs of lines of different roots connect. The shingles that a line has in common with
    each other one are counted exactly: those of OFTEN lines or more by a product of matrices, rarer ones by the lines that hold them.
    The lines of the most frequent root are only compared with."""
    names, label, held = np.unique(np.array(roots, dtype=np.int64), return_inverse=True, return_counts=True)
    last = label == np.argmax(held)
    order = np.r_[np.flatnonzero(~last), np.flatnonzero(last)]
    label = label[order]
    own_label, count = label.copy(), len(order)
    ids, n = line_sets([lines[i] for i in order.tolist()])
    line, holders = np.repeat(np.arange(count), n), np.bincount(ids)
    often = holders >= OFTEN
    column, wide = np.cumsum(often) - 1, max(1, CELLS // count)
    full = often[ids]
    full_line, full_column = line[full], column[ids[full]]
    rare = (holders[ids] > 1) & ~full
    rare_line, rare_id = line[rare], ids[rare]
    mine = np.searchsorted(rare_line, np.arange(count + 1))
    holder = rare_line[np.argsort(rare_id, kind="stable")]
    at = np.r_[0, np.cumsum(np.bincount(rare_id, minlength=len(holders)))]
    out, others = [], int((~last).sum())
    for start in range(0, others, AT_ONCE):
        end = min(others, start + AT_ONCE)
        both = np.zeros((end - start, count), dtype=np.float32)
        for c in range(0, int(often.sum()), wide):
            some = (full_column >= c) & (full_column < c + wide)
            has = np.zeros((count, wide), dtype=np.float32)
            has[full_line[some], full_column[some] - c] = 1
            both += has[start:end] @ has.T
        for x in range(start, end):
            own = rare_id[mine[x] : mine[x + 1]]
            more = np.bincount(holder[places(at[own], at[own + 1] - at[own])], minlength=count)
            common = both[x - start].astype(np.int64) + more
            near = (label != label[x]) & (common >= similar * (n[x] + n - common))
            while near.any():
                y = int(np.argmax(near))
                out.append((int(names[own_label[x]]), int(names[own_label[y]])))
                label[label == label[x]] = label[y]
                near &= label != label[x]
    return out


def _compared(pieces: DataFrame, texts: DataFrame, similar: float, joins: bool = False) -> DataFrame:
    """Links (a, b) of lines within pieces (run, i, j, h) by exact similarity, or of roots if pieces have these too and `joins`. Pieces are
    read one after another, and small ones compared at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[pa.RecordBatch]:
            links = joining(lines, hashes, similar) if joins else [(hashes[x], hashes[y]) for x, y in spanning(lines, starts, similar)]
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], ["a", "b"])

        hashes, lines, starts, last, chars = [], [], [], None, 0
        for batch in batches:
            for *piece, h, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if piece != last:
                    if lines and (joins or chars >= CHUNK):
                        yield from out()
                        hashes, lines, starts, chars = [], [], [], 0
                    starts.append(len(lines))
                    last = piece
                hashes.append(h)
                lines.append(line)
                chars += len(line)
        if lines:
            yield from out()

    with_text = pieces.join(texts, "h").select("run", "i", "j", "root" if joins else "h", "line")
    return with_text.repartition("run", "i", "j").sortWithinPartitions("run", "i", "j").mapInArrow(run, "a long, b long")


def _left(runs: DataFrame, long: DataFrame, labels: DataFrame) -> DataFrame:
    """(run, i, j, h, root): the pieces of long runs in which lines of different roots meet. Of each run the lines of the most
    frequent root and the others are dealt to blocks; each block of others meets all other blocks."""
    half = max(1, RUN // 2)
    lines = runs.join(F.broadcast(long.select("run")), "run").join(labels.withColumnRenamed("node", "h"), "h", "left")
    lines = save(lines.select("run", "h", F.coalesce("root", "h").alias("root")), "rooted-lines")
    roots = lines.groupBy("run", "root").agg(F.count("*").alias("m"))
    main = roots.groupBy("run").agg(F.max(F.struct("m", "root")).alias("main"), F.sum("m").alias("n")).where("main.m < n")
    blocks = lambda n: F.ceil(n / half).cast("int")
    both = lines.join(F.broadcast(main.select("run", F.col("main.root").alias("first"), blocks(F.col("n") - F.col("main.m")).alias("others"), blocks(F.col("main.m")).alias("firsts"))), "run")
    dealt = lambda n: F.pmod(F.xxhash64("h"), F.col(n)).cast("int")
    both = both.withColumn("b", F.when(F.col("root") == F.col("first"), F.col("others") + dealt("firsts")).otherwise(dealt("others")))
    meets = F.when(F.col("b") >= F.col("others"), F.sequence(F.lit(0), F.col("others") - 1)).otherwise(F.array_remove(F.sequence(F.lit(0), F.col("others") + F.col("firsts") - 1), F.col("b")))
    met = both.withColumn("other", F.explode(meets))
    return met.select("run", F.least("b", "other").alias("i"), F.greatest("b", "other").alias("j"), "h", "root")


def run_components(runs: DataFrame, texts: DataFrame, similar: float) -> DataFrame:
    """(node, root) of all lines that are linked within runs. A run is compared whole, or, if it is longer than an eighth of RUN, by parts
    of that size that share its first line. Since most of what such a run connects is then connected, through other runs too, only lines
    of different components of it are compared again (`joining`), whatever their parts. So nothing is lost, and no run takes all its pairs."""
    part = max(2, RUN // 8)
    long = save(runs.groupBy("run").agg(F.count("*").alias("n"), F.min("h").alias("first")).where(F.col("n") > part), "long")
    zero = F.lit(0).alias("i")
    if long.isEmpty():
        return components(save(_compared(runs.select("run", zero, F.lit(0).alias("j"), "h"), texts, similar), "similar"))
    parts = F.ceil(F.col("n") / part).cast("int")
    dealt = runs.join(F.broadcast(long), "run", "left").where("first is null or first <> h")
    dealt = dealt.select("run", zero, F.coalesce(F.pmod(F.xxhash64("h", "run"), parts).cast("int"), F.lit(0)).alias("j"), "h")
    firsts = long.select("run", zero, F.explode(F.sequence(F.lit(0), parts - 1)).alias("j"), F.col("first").alias("h"))
    labels = components(save(_compared(dealt.union(firsts), texts, similar), "similar"))
    tidy(runs.sparkSession)
    more = components(save(_compared(_left(runs, long, labels), texts, similar, joins=True), "joins"))
    tidy(runs.sparkSession)
    again = labels.join(more.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return again.union(more.join(labels.select("node"), "node", "left_anti").select("node", "root"))


def line_components(docs: DataFrame, firsts: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """(h, root) of all lines that have a similar one. docs: (doc, tie, data); firsts: (h, f) of each line, f its first place."""
    spark = docs.sparkSession
    runs = save(_runs(_bands(docs)).distinct(), "runs")
    tidy(spark)
    first = firsts.join(runs.select("h").distinct(), "h").select("h", "f.doc", "f.tie", "f.no")
    texts = save(_texts(docs, first), "lines")
    tidy(spark)
    return run_components(runs, texts, similar).withColumnRenamed("node", "h")


def dropped_lines(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """(doc, tie, gone): by text that loses lines, their numbers from 0. Of each component of lines the first stays: the one of
    the least (doc, tie), then number. docs: (doc, tie, data)."""
    seen = save(_occurrences(docs), "occurrences")
    firsts = save(seen.groupBy("h").agg(F.min(F.struct("doc", "tie", "no")).alias("f"), F.count("*").alias("n")), "firsts")
    comp = line_components(docs, firsts, similar)
    # Only lines that have a copy or a similar line can go.
    rooted = save(firsts.join(comp, "h", "left").where("n > 1 or root is not null").select("h", F.coalesce("root", "h").alias("root"), "f"), "rooted")
    best = rooted.groupBy("root").agg(F.min("f").alias("best"))
    keep = rooted.join(best, "root").select("h", "best")
    gone = seen.join(keep, "h").where(F.struct("doc", "tie", "no") != F.col("best"))
    out = save(gone.groupBy("doc", "tie").agg(F.collect_list("no").alias("gone")), "gone")
    tidy(docs.sparkSession)
    return out


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR) -> DataFrame:
    """Keep of every group of similar lines in the table one line, the first.

    Lines are what stands between line feeds; lines of white space only stay and are compared with none. Two lines link at
    a Jaccard similarity of at least `similar` of their sets of 8-character shingles (a shorter line is one shingle), groups
    are what links reach, and the first line is that of the least id, then of the least number; null ids come last.
    Lines that differ by one inner character so link from 79 characters on. Returns the rows of df with text_col replaced (a null
    text becomes empty) and n_lines and n_removed (of lines that aren't blank), which replace columns of these names; other columns
    stay, whatever their names. Equal rows are one text and share its result, so a line that only they hold stays in each; texts and
    lines of any length are compared whole; an empty table gives no rows.
    """
    session(df.sparkSession)
    new = ("n_lines", "n_removed")
    df = df.select(*[c for c in df.columns if c not in new])
    docs, unique = keyed(df, id_col, text_col)
    gone = dropped_lines(unique, similar)
    # The same plan at every size: small tables would be broadcast, and figures taken from them wouldn't hold for large ones.
    out = docs.join(gone.hint("merge"), ["doc", "tie"], "left").select("id", "rest", "data", "gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n, m = [], [], []
            for data, gone in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                lines, drop = split_lines(data), set(gone or ())
                texts.append((b"\n".join(x for i, x in enumerate(lines) if i not in drop) if drop else data).decode("utf-8", "replace"))
                n.append(sum(1 for x in lines if x and not x.isspace()))
                m.append(len(drop))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(n, pa.int64()), pa.array(m, pa.int64())], ["id", "rest", "text", "n_lines", "n_removed"])

    schema = T.StructType([out.schema["id"], out.schema["rest"], T.StructField("text", T.StringType()), *(T.StructField(c, T.LongType()) for c in new)])
    got = out.mapInArrow(run, schema)
    names = {id_col: "id", text_col: "text"}
    return got.select(*[F.col(names[c]).alias(c) if c in names else F.col("rest").getField(c).alias(c) for c in df.columns], *new)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dedup_lines of the whole table `documents`, with a digest of each text that is left."""
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"), F.octet_length("text").cast("long").alias("kept_bytes"))
