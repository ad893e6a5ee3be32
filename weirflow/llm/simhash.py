"""SimHash near-duplicates by pigeonhole blocks."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.llm.common import arrow_map, components, save, session, table

BITS = 64
#: Runs of one block value up to this length are compared by shifts, longer ones by a search that keeps spanning links.
SHORT_RUN = 16
#: A block value shared by more fingerprints than this is split on further bits.
HOT_RUN = 20_000


def fingerprint(text: str | None, ngram: int = 3, seed: int = 42) -> int:
    """The fingerprint of one text, unsigned; 0 if it has no words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    join, digest = b" ".join, xxhash.xxh64_intdigest
    if len(words) <= ngram:
        shingles = [join(words)]
    else:
        shingles = map(join, zip(*(words[i:] for i in range(ngram)), strict=False))
    h = np.array([digest(s, seed) for s in shingles], dtype="<u8")
    # Set bits are counted in blocks, so that a long text's bits aren't unpacked at once.
    ones = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(h), 4096):
        ones += np.unpackbits(h[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def _split(mask: int, parts: int) -> list[int]:
    """The bits of mask in `parts` runs of nearly equal length, each as a mask."""
    bits = [i for i in range(BITS) if mask >> i & 1]
    ends = [round(len(bits) * k / parts) for k in range(parts + 1)]
    return [sum(1 << b for b in bits[x:y]) for x, y in zip(ends, ends[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def block_masks(distance: int) -> list[int]:
    """Masks of which any two fingerprints at most `distance` bits apart agree on one: of distance + 2 blocks, every two."""
    blocks = _split((1 << BITS) - 1, distance + 2)
    return [a | b for a, b in combinations(blocks, 2)]


def _span(fp: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that connect what is connected within one long run; each search step looks only at what isn't reached yet."""
    out, rest = [], np.arange(1, len(fp))
    queue = [0]
    while queue or len(rest):
        if not queue:
            queue, rest = [int(rest[0])], rest[1:]
        x = queue.pop()
        near = np.bitwise_count(fp[rest] ^ fp[x]) <= distance
        if near.any():
            found = rest[near]
            rest = rest[~near]
            out += [(x, int(y)) for y in found]
            queue += found.tolist()
    return out


def _links(key: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among fingerprints of equal key; both arrays are sorted by key."""
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    length = np.diff(np.r_[start, len(key)])
    left, right = [], []
    per_row = np.repeat(length, length)
    short = np.flatnonzero((per_row > 1) & (per_row <= SHORT_RUN))
    k, f = key[short], fp[short]
    for d in range(1, SHORT_RUN):
        if len(k) <= d:
            break
        hit = np.flatnonzero((k[d:] == k[:-d]) & (np.bitwise_count(f[d:] ^ f[:-d]) <= distance))
        left.append(f[hit])
        right.append(f[hit + d])
    for s, n in zip(start[length > SHORT_RUN], length[length > SHORT_RUN], strict=True):
        run = np.unique(fp[s : s + n])
        pairs = np.array(_span(run, distance), dtype=np.int64).reshape(-1, 2)
        left.append(run[pairs[:, 0]])
        right.append(run[pairs[:, 1]])
    none = np.empty(0, dtype=np.uint64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _near(rows: DataFrame, distance: int) -> DataFrame:
    """rows: (key, fp). Spanning links (a, b) of what is near and shares a key; a partition's runs are read one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_k, held_f = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)

        def out(k: np.ndarray, f: np.ndarray) -> Iterator[pa.RecordBatch]:
            a, b = _links(k, f, distance)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            held_k = np.concatenate([held_k, batch.column(0).to_numpy(zero_copy_only=False)])
            held_f = np.concatenate([held_f, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
            if len(held_k) < 65_536:
                continue
            cut = int(np.searchsorted(held_k, held_k[-1]))  # the last run may go on in the next batch
            yield from out(held_k[:cut], held_f[:cut])
            held_k, held_f = held_k[cut:], held_f[cut:]
        if len(held_k):
            yield from out(held_k, held_f)

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = 3) -> DataFrame:
    """One row (id, fp long) for each row of df."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.array([fingerprint(x, ngram) for x in b.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["id", "fp"])

    return arrow_map(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), run, "id long, fp long")


def near_fingerprints(prints: DataFrame, distance: int = 3) -> DataFrame:
    """Links (a, b) between the distinct fingerprints `prints` (fp) that connect all that are within `distance` bits.

    Close pairs agree on two of distance + 2 blocks. A value shared by more than HOT_RUN fingerprints is split on the
    rest of its bits in distance + 1 parts, of which a close pair again agrees on one, until it has no bits left.
    """
    spark, parts = prints.sparkSession, distance + 1
    masks, links = block_masks(distance), None
    key = F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("mask"))).alias("key")
    rows = prints.select("fp", F.explode(F.array(*[F.lit(_signed(m)).cast("long") for m in masks])).alias("mask")).select(key, "fp", "mask")
    while True:
        hot = save(rows.groupBy("key").count().where(F.col("count") > HOT_RUN).select("key"), "hot")
        full = hot.isEmpty() or all(m == (1 << BITS) - 1 for m in masks)
        found = _near((rows if full else rows.join(hot, "key", "left_anti")).select("key", "fp"), distance)
        links = found if links is None else links.union(found)
        if full:
            return links
        finer = {m: [m | x for x in _split(~m & ((1 << BITS) - 1), parts) if x] or [m] for m in masks}
        masks = sorted({x for xs in finer.values() for x in xs})
        to = spark.createDataFrame([(_signed(m), _signed(x)) for m, xs in finer.items() for x in xs], "mask long, finer long")
        rows = save(rows.join(hot, "key", "left_semi").join(F.broadcast(to), "mask").select("fp", F.col("finer").alias("mask")).distinct().select(key, "fp", "mask"), "finer")


def simhash_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = 3, distance: int = 3) -> DataFrame:
    """Near-duplicate groups by SimHash.

    Returns one row per row of df: (id_col long, fingerprint string of 16 hex digits, component_id long: the smallest id
    that links reach). Null, empty and blank texts have fingerprint zero and link like any other; texts are read whole;
    repeated rows give repeated results; a null id takes part but never names a component unless all its ids are null.
    Extra columns are ignored; an empty table gives an empty result.
    """
    session(df.sparkSession)
    prints = save(fingerprints(df, id_col, text_col, ngram), "prints")
    classes = save(prints.groupBy("fp").agg(F.min("id").alias("least")), "classes")
    comp = components(near_fingerprints(classes.select("fp"), distance))
    rooted = classes.join(comp.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = save(rooted.select("fp", "root").join(named, "root").select("fp", "component_id"), "named")
    return prints.join(by_print, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """simhash_groups of the whole table `documents`."""
    return simhash_groups(table(spark, sf_dir, "documents"))
