"""Near-duplicate vectors by sorted projection passes."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.llm.common import components, save, session, table

COSINE = 0.95
#: Passes, sign bits of a key and vectors that follow one in a pass's order that it is compared with. Two vectors of cosine
#: 0.95 differ in a sign with probability 0.1: in each pass they share the first bits of the key, and so stand close.
PASSES, KEY_BITS, WINDOW = 16, 48, 24
#: Passes are as many, PASSES at least, that a pair at the threshold shares a run of leading bits in one of them but for this share.
MISSED = 0.001
#: Vectors of a component that are compared at once to count its links.
BLOCK = 1024


def unit_vectors(vs: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit rows in double precision, which rows are usable, their lengths). Null, empty and zero vectors and such with null or
    non-finite components are not usable. Shorter vectors are filled up with zeros; vectors of unlike length have no cosine."""
    size = np.array([len(v) if v is not None else 0 for v in vs], dtype=np.int64)
    ok = np.array([bool(v) and None not in v for v in vs], dtype=bool)
    out = np.zeros((len(vs), max(1, size.max(initial=0))))
    for n in np.unique(size[ok]):
        at = np.flatnonzero(ok & (size == n))
        out[at, :n] = np.array([vs[i] for i in at], dtype=float)
    ok &= np.isfinite(out).all(axis=1)
    out[~ok] = 0
    big = np.abs(out).max(axis=1, initial=0)
    out /= np.where(big > 0, big, 1)[:, None]  # squares of very large or small components stay finite
    norm = np.sqrt((out * out).sum(axis=1))
    ok &= norm > 0
    return out / np.where(norm > 0, norm, 1)[:, None], ok, size


def forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of links between numbers below n as few as connect what they connect: each number that isn't the least of its component
    with one that is."""
    label = np.arange(n)
    while len(a):
        least = np.minimum(label[a], label[b])
        if (label[a] == least).all() and (label[b] == least).all():
            break
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        label = label[label]
    joined = np.flatnonzero(label != np.arange(n))
    return label[joined], joined


def sort_keys(x: np.ndarray, passes: int, seed: int = 5) -> np.ndarray:
    """By row and pass, the signs of KEY_BITS random projections, the first the most significant."""
    planes = np.random.default_rng([seed, x.shape[1]]).standard_normal((passes * KEY_BITS, x.shape[1]))
    bits = (x @ planes.T > 0).reshape(len(x), passes, KEY_BITS)
    return (bits * (1 << np.arange(KEY_BITS - 1, -1, -1, dtype=np.int64))).sum(axis=2)


def run_bits(n: int, window: int) -> int:
    """Leading bits of which n evenly spread keys have runs of about `window`."""
    return min(KEY_BITS, max(0, int(np.ceil(np.log2(max(n, 1) / window)))))


def passes_for(bits: int, cosine: float) -> int:
    """Passes after which a pair of that cosine has shared the first `bits` bits of a key, but for MISSED of the cases."""
    once = (1 - np.arccos(np.clip(cosine, -1, 1)) / np.pi) ** bits
    return 1 if once >= 1 - MISSED else int(np.ceil(np.log(MISSED) / np.log1p(-once)))


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = COSINE, passes: int = PASSES, window: int = WINDOW) -> DataFrame:
    """Link vectors of cosine at least `cosine` in double precision.

    Equal vectors are one class first. In each pass the classes are ordered by a key of random signs, range-partitioned, and
    each is compared with the next `window` (a partition also holds the first rows of the one that follows). Where more than
    that share the leading bits of which evenly spread keys would have runs of a window, all of the run are compared, block by
    block; verified pairs of all passes are united. Then all links within a component are counted, block by block, so what
    wasn't reached counts as well. A link is lost only if its ends share those bits in no pass, nor those of a chain of links
    between them; passes grow with the input, so that this stays rare (MISSED). `passes` is the least number of them.

    Returns one row per row of df: id_col, n_links (other rows linked directly), component_id (the least id that links
    reach, itself included) and kept (id = component_id). Null, empty and zero vectors and such with null or non-finite components link
    with nothing, and vectors of unlike length never with each other; rows of equal id and vector count as distinct rows; a null id is
    never kept, and takes part otherwise. Cosines are ties with the threshold if they equal it, and link. Extra columns are ignored;
    an empty table gives no rows.
    """
    spark = session(df.sparkSession)
    vec = F.transform(F.col(vec_col), lambda v: v.cast("double"))
    usable = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = df.select(F.col(id_col).cast("long").alias("id"), vec.alias("v"))
    coded = rows.withColumn("h", F.when(F.coalesce(usable, F.lit(False)), F.xxhash64("v")))
    slim = save(coded.select("id", "h"), "ids")
    classes = save(coded.where("h is not null").groupBy("h").agg(F.first("v").alias("v"), F.min("id").alias("least"), F.count("*").alias("copies")), "vectors")

    lead = run_bits(classes.count(), window)
    passes = max(passes, passes_for(lead, cosine))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, _, size = unit_vectors(b.column(1).to_pylist())
            k = np.zeros((len(x), passes), dtype=np.int64)
            for n in np.unique(size):
                k[size == n] = sort_keys(x[size == n, :n], passes)
            for p in range(passes):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), p, dtype=np.int32)), pa.array(size), pa.array(k[:, p]), b.column(0), b.column(1)], ["pass", "dim", "key", "h", "v"])

    schema = "pass int, dim long, key long, h long, v array<double>"
    keyed = save(classes.select("h", "v").mapInArrow(keys, schema), "keys")
    order = ["pass", "dim", "key", "h"]
    placed = save(keyed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id()), "order")
    # The rows that follow a partition's last ones also go to it, at its end; where the next partition is short, from those after it too.
    start = placed.groupBy("part").agg(F.min("row").alias("start"), F.count("*").alias("n"))
    parts = sorted((r["part"], r["n"]) for r in start.collect())
    ends = np.cumsum([n for _, n in parts]).tolist()
    reach = [(q, p, ends[i] + window - ends[j - 1]) for i, (p, _) in enumerate(parts) for j, (q, _) in itertools.takewhile(lambda x: ends[x[0] - 1] < ends[i] + window, enumerate(parts[i + 1 :], i + 1))]
    before = spark.createDataFrame(reach, "part int, before int, most long")
    heads = placed.join(F.broadcast(start.drop("n")), "part").join(F.broadcast(before), "part").where(F.col("row") < F.col("start") + F.col("most"))
    both = placed.select("part", "row", "pass", "h", "v", F.lit(False).alias("head")).union(heads.select("before", "row", "pass", "h", "v", F.lit(True)))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(part: list, p: list, h: list, v: list, head: list) -> Iterator[pa.RecordBatch]:
            x, _, size = unit_vectors(v)
            part, p, h, head = np.array(part), np.array(p), np.array(h), np.array(head)
            left, right = [], []
            for d in range(1, window + 1):
                if d >= len(h):
                    break
                same = (part[d:] == part[:-d]) & (p[d:] == p[:-d]) & (size[d:] == size[:-d]) & ~head[:-d]
                at = np.flatnonzero(same)
                hit = at[np.einsum("ij,ij->i", x[at], x[at + d]) >= cosine]
                left.append(hit)
                right.append(hit + d)
            if left and sum(map(len, left)):
                # Links are counted later, inside components: here those are enough that connect them.
                a, b = forest(np.concatenate(left), np.concatenate(right), len(h))
                yield pa.RecordBatch.from_arrays([pa.array(h[a]), pa.array(h[b])], ["a", "b"])

        held: list[list] = [[], [], [], [], []]
        for b in batches:
            for c, k in zip(held, (0, 2, 3, 4, 5), strict=True):
                c += b.column(k).to_pylist()
            if len(held[0]) > 4096:
                yield from out(*held)
                held = [c[-window:] for c in held]  # pairs within these come twice, which is harmless
        if held[0]:
            yield from out(*held)

    links = both.repartition("part").sortWithinPartitions("part", "row").mapInArrow(compare, "a long, b long").distinct()
    run = F.xxhash64("pass", "dim", F.shiftrightunsigned("key", KEY_BITS - lead) if lead else F.lit(0))
    in_runs = placed.select(run.alias("root"), "h", "v", F.lit(1).cast("long").alias("copies"))
    long_runs = save(in_runs.groupBy("root").count().where(F.col("count") > window + 1).select("root"), "runs")
    if not long_runs.isEmpty():
        links = links.union(_spanning(in_runs.join(long_runs, "root", "left_semi"), cosine))
    comp = components(save(links, "near"))
    member = save(comp.withColumnRenamed("node", "h").join(classes, "h"), "members")
    counts = _links_inside(member, cosine)
    named = member.groupBy("root").agg(F.min("least").alias("component_id"))
    info = classes.select("h", "least", "copies").join(comp.withColumnRenamed("node", "h"), "h", "left").join(named, "root", "left").join(counts, "h", "left")
    info = save(info.select("h", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id")), "info")
    out = slim.join(info, "h", "left")
    cid = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), cid.alias("component_id"), F.coalesce(F.col("id") == cid, F.lit(False)).alias("kept"))


def _links_inside(member: DataFrame, cosine: float) -> DataFrame:
    """(h, links): copies of other classes of its component that each class links with."""

    def piece(one: np.ndarray, two: np.ndarray | None, h: np.ndarray, copies: np.ndarray, near: Callable) -> tuple[np.ndarray, np.ndarray]:
        hit = near(one, one if two is None else two)
        if two is None:
            np.fill_diagonal(hit, False)
            return h, (hit * copies[None, :]).sum(axis=1)
        return np.r_[h[one], h[two]], np.r_[hit @ copies[two], hit.T @ copies[one]]

    return _by_blocks(member, piece, cosine, ["h", "links"]).groupBy("h").agg(F.sum("links").alias("links"))


def _spanning(member: DataFrame, cosine: float) -> DataFrame:
    """Pairs (a, b) that connect all that links connect within each root; a piece sends fewer than it has classes."""

    def piece(one: np.ndarray, two: np.ndarray | None, h: np.ndarray, copies: np.ndarray, near: Callable) -> tuple[np.ndarray, np.ndarray]:
        other = one if two is None else two
        i, j = np.nonzero(near(one, other))
        a, b = forest(one[i], other[j], len(h))
        return h[a], h[b]

    return _by_blocks(member, piece, cosine, ["a", "b"])


def _by_blocks(member: DataFrame, piece: Callable, cosine: float, names: list[str]) -> DataFrame:
    """What piece gives for each pair of blocks of the classes (root, h, v, copies) of one root, as two columns of longs. Roots
    are cut into blocks of BLOCK classes, and each pair of blocks is one piece of work: no task holds more, and no pair is sent."""
    size = member.groupBy("root").agg(F.count("*").alias("n"))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    cut = member.join(size, "root").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("h"), F.col("blocks")).cast("int"))
    # Block i meets block j in the work (min, max).
    pieces = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pieces = pieces.select("root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), F.col("block"), "h", "v", "copies")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of(held: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
            _, i, j, *_ = held[0]
            block, h, copies = (np.array([x[k] for x in held]) for k in (3, 4, 6))
            x, _, size = unit_vectors([t[5] for t in held])

            def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
                return (x[a] @ x[b].T >= cosine) & (size[a][:, None] == size[b][None, :])

            return piece(np.flatnonzero(block == i), None if i == j else np.flatnonzero(block == j), h, copies, near)

        def out(done: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*done, strict=True)], names)

        held: list[tuple] = []
        done: list = []
        for b in batches:
            for x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and held[0][:3] != x[:3]:
                    done.append(of(held))
                    held = []
                    if len(done) >= 2000:
                        yield out(done)
                        done = []
                held.append(x)
        if held:
            done.append(of(held))
        if done:
            yield out(done)

    return pieces.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j").mapInArrow(run, f"{names[0]} long, {names[1]} long")


#: The same by all pairs; components by closure of the links.
OP3_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id a, b.vec_id b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
n AS (SELECT a, count(*) n FROM links GROUP BY a), c AS (SELECT a, min(b) c FROM reach GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) n_links, coalesce(c, vec_id) component_id, vec_id = coalesce(c, vec_id) kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id
"""


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_duplicates of the whole table `embeddings`, whatever its labels."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))
