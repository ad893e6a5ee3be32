"""Document scores by a gated recurrent language model.

Word counts of all training documents make the vocabulary: the HEAD most frequent words are predicted one by one, in
classes of CLASS by frequency; all others by their orthographic bucket and, in that, by their smoothed share of its count.
A GRU carries its state through a whole document; it is trained by truncated backpropagation in numpy. Training documents are
dealt to groups by a hash of their text, so what the model learns doesn't follow the partitions of its input; each group's
weights and optimiser sums are averaged with the others' after each round.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache, partial
from heapq import heapify, heapreplace
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.llm.common import save, session, table, tidy

HEAD, CLASS, BUCKETS = 2048, 64, 32
EMBED, HIDDEN = 24, 32
CLASSES = HEAD // CLASS + BUCKETS
#: Words whose counts are broadcast; the counts of rarer ones are joined.
KNOWN = 1 << 16
#: Lanes and steps of a training window, and rounds, which deal all of a group's documents among them.
LANES, STEPS, ROUNDS, RATE = 256, 16, 4, 0.05
#: Bytes of text of a training group, about.
GROUP_BYTES = 1 << 24
#: Tokens after which training starts a long document's next piece with a fresh state, so that no lane outlasts the others.
PIECE = 1024
#: Lanes and steps when scoring, and tokens that a task scores together.
SCORE_LANES, SCORE_STEPS, TOGETHER = 256, 32, 1 << 21
#: Rows whose class logits are made together, so that they stay in a core's cache.
ROWS = 1024
#: Distinct words that a task counts at once.
REMEMBERED = 400_000
#: Averages are taken of so many tasks' weights at a time.
FAN_IN = 64
END = b"\n"
#: Columns of texts whose words are counted and told apart.
CODED = "row long, id long, held_out boolean, key long, n_tokens long, n_known long, base double, tails double, rare array<long>, symbols binary"


def words(text: str | None) -> list[bytes]:
    """What stands between ASCII white space, A-Z in lower case, and one end."""
    out = (text or "").encode("utf-8", "replace").lower().split()
    out.append(END)
    return out


def word_hash(w: bytes) -> int:
    """64 bits, signed; the low ones are the word's bucket, a hash of its last two bytes."""
    h = xxhash.xxh3_64_intdigest(w) & ~(BUCKETS - 1) | xxhash.xxh32_intdigest(w[-2:]) % BUCKETS
    return h - (1 << 64) if h >> 63 else h


def end_hash() -> int:
    return word_hash(END)


@cache
def _bucket_of() -> np.ndarray:
    """Bucket of a word by its last two bytes, a little-endian number; of one byte alone by 65536 and it."""
    two = [xxhash.xxh32_intdigest(k.to_bytes(2, "little")) % BUCKETS for k in range(1 << 16)]
    return np.array(two + [xxhash.xxh32_intdigest(bytes([k])) % BUCKETS for k in range(256)], dtype=np.uint64)


def word_hashes(ws: pa.Array) -> np.ndarray:
    """word_hash of each of ws, none of them empty."""
    if not len(ws):
        return np.empty(0, dtype=np.int64)
    ends, data = np.frombuffer(ws.buffers()[1], dtype=np.int32)[ws.offset : ws.offset + len(ws) + 1], ws.buffers()[2].to_pybytes()
    b = np.frombuffer(data, dtype=np.uint8)
    last, more = b[ends[1:] - 1].astype(np.intp), np.diff(ends) > 1
    bucket = _bucket_of()[np.where(more, b[np.maximum(ends[1:] - 2, 0)] + (last << 8), 65536 + last)]
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, [data[i:j] for i, j in pairwise(ends.tolist())]), dtype=np.uint64, count=len(ws))
    return (h & ~np.uint64(BUCKETS - 1) | bucket).view(np.int64)


def coded_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens of each text, its end included; all tokens as places among the distinct ones; the hashes of these). Same as `words`, but
    a word is looked at in Python once for all texts."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    tokens, size = lists.flatten(), np.diff(lists.offsets.to_numpy()).astype(np.int64)
    empty = np.flatnonzero(pc.equal(pc.binary_length(tokens), 0).to_numpy(zero_copy_only=False))
    if len(empty):  # before leading white space and after trailing one
        size = size - np.bincount(np.searchsorted(np.cumsum(size), empty, "right"), minlength=len(size))
        tokens = tokens.filter(pc.not_equal(pc.binary_length(tokens), 0))
    found = tokens.dictionary_encode()
    size = size + 1
    at = np.empty(size.sum(), dtype=np.int32)
    end = np.zeros(len(at), dtype=bool)
    end[np.cumsum(size) - 1] = True
    at[end], at[~end] = len(found.dictionary), found.indices.to_numpy()
    return size, at, np.r_[word_hashes(found.dictionary), end_hash()]


class Vocabulary:
    """The words of known count by their hashes, the most frequent first."""

    def __init__(self, hashes: np.ndarray):
        self.order = np.argsort(hashes)
        self.sorted = hashes[self.order]
        self.symbols_of = np.where(np.arange(len(hashes)) < HEAD, np.arange(len(hashes)), HEAD + (hashes & (BUCKETS - 1))).astype(np.int32)

    def codes(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash among the words of known count; of another word -1 minus its place in h."""
        at = np.minimum(np.searchsorted(self.sorted, h), len(self.sorted) - 1)
        return np.where(self.sorted[at] == h, self.order[at], -1 - np.arange(len(h)))

    def symbols(self, codes: np.ndarray, h: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(symbols of the model, hashes of the other words in order)."""
        out, other = self.symbols_of[np.maximum(codes, 0)], codes < 0
        others = h[-1 - codes[other]] if other.any() else np.empty(0, dtype=np.int64)
        out[other] = HEAD + (others & (BUCKETS - 1))
        return out, others


def count_words(docs: DataFrame) -> DataFrame:
    """(h, n) of the words of all texts of docs (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            h, at = np.unique(np.concatenate([h for h, _ in held]), return_inverse=True)
            return h, np.bincount(at, np.concatenate([n for _, n in held]), len(h)).astype(np.int64)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in merged()], ["h", "n"])

        for b in batches:
            if not b.num_rows:
                continue
            _, at, h = coded_words(b.column(0))
            held.append((h, np.bincount(at, minlength=len(h))))
            if sum(len(h) for h, _ in held) > 2 * REMEMBERED:
                held = [merged()]
                if len(held[0][0]) > REMEMBERED:
                    yield out()
                    held = []
        if held:
            yield out()

    return docs.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


SHAPES = {"E": (HEAD + BUCKETS, EMBED), "Wx": (EMBED, 3 * HIDDEN), "b": (3 * HIDDEN,), "Wh": (HIDDEN, 3 * HIDDEN), "C": (HIDDEN, CLASSES), "cb": (CLASSES,), "O": (HEAD, HIDDEN), "ob": (HEAD,)}


def start_weights(head_counts: np.ndarray, bucket_counts: np.ndarray) -> dict[str, np.ndarray]:
    """Weights that predict by counts alone until they are trained. A head place without a word can't be predicted."""
    rng = np.random.default_rng(3)
    p = {k: (rng.standard_normal(s) * 0.1).astype(np.float32) for k, s in SHAPES.items()}
    full = np.zeros(HEAD)
    full[: len(head_counts)] = head_counts
    p["ob"] = np.where(np.arange(HEAD) < len(head_counts), np.log(full + 0.5), -60).astype(np.float32)
    classes = np.r_[full.reshape(-1, CLASS).sum(axis=1), bucket_counts]
    some = np.r_[np.arange(HEAD // CLASS) * CLASS < len(head_counts), np.ones(BUCKETS, dtype=bool)]
    p["cb"] = np.where(some, np.log(classes + 0.5), -60).astype(np.float32)
    p["b"][:], p["C"][:], p["O"][:] = 0, 0, 0
    return p


def pack_weights(p: dict[str, np.ndarray]) -> bytes:
    return b"".join(p[k].astype("<f4").tobytes() for k in SHAPES)


def unpack_weights(data: bytes) -> dict[str, np.ndarray]:
    out, at, flat = {}, 0, np.frombuffer(data, dtype="<f4")
    for k, s in SHAPES.items():
        n = int(np.prod(s))
        out[k] = flat[at : at + n].reshape(s).copy()
        at += n
    return out


ROOM: dict = {}


def _room(*shape: int | np.dtype) -> list[np.ndarray]:
    """Arrays for the steps of a window, the same ones again for the next: memory taken anew each time costs more than filling it."""
    if shape not in ROOM:
        ROOM.clear()
        steps, lanes, n, kind = shape
        ROOM[shape] = [np.empty((steps, lanes, k * n), dtype=kind) for k in (2, 1, 1, 3, 3, 3, 2)]
    return ROOM[shape]


def forward(p: dict, table_: np.ndarray, ids: np.ndarray, fresh: np.ndarray, h: np.ndarray, keep: bool = True) -> tuple[np.ndarray, tuple]:
    """States after each step, (steps, lanes, HIDDEN), and what backward needs, which the next call overwrites; without keep each step
    overwrites that of the one before. ids: inputs; fresh: where a document starts. The gates and the candidate of a step are each one
    block of memory, and tanh is made of exp, which numpy has faster."""
    n, steps, ids = HIDDEN, len(ids), ids.astype(np.intp)
    gate, candidate = (np.ascontiguousarray(x) for x in np.split(table_, [2 * n], axis=1))
    gates, cs, was, us, *_ = _room(steps if keep else 1, ids.shape[1], n, table_.dtype)
    out, starts = np.empty((steps, ids.shape[1], n), dtype=table_.dtype), [np.flatnonzero(f) for f in fresh]
    with np.errstate(over="ignore"):
        for t in range(steps):
            at = t if keep else 0
            g, c, w, u, new = gates[at], cs[at], was[at], us[at], out[t]
            np.copyto(w, h)
            if len(starts[t]):
                w[starts[t]] = 0
            np.matmul(w, p["Wh"], out=u)
            np.take(gate, ids[t], axis=0, out=g, mode="clip")
            g += u[:, : 2 * n]
            np.negative(g, out=g)
            np.exp(g, out=g)
            g += 1
            np.reciprocal(g, out=g)
            np.take(candidate, ids[t], axis=0, out=c, mode="clip")
            c += np.multiply(g[:, n:], u[:, 2 * n :], out=new)
            c *= 2
            np.exp(c, out=c)
            c += 1
            np.divide(-2, c, out=c)
            c += 1
            np.subtract(w, c, out=new)
            new *= g[:, :n]
            new += c
            h = new
    return out, (gates, cs, was, us, starts)


def class_of(ids: np.ndarray) -> np.ndarray:
    return np.where(ids < HEAD, ids // CLASS, ids - HEAD + HEAD // CLASS)


def _by_class(k: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, slice]]]:
    """(places of head words in order of their class k, for each class found its range of that order and its rows of O)."""
    order = np.argsort(k.astype(np.uint16), kind="stable")
    ends = np.searchsorted(k[order], np.arange(HEAD // CLASS + 1))
    found = np.flatnonzero(np.diff(ends))
    return order[: ends[-1]], [(a, b, slice(c * CLASS, (c + 1) * CLASS)) for a, b, c in zip(ends[found].tolist(), ends[found + 1].tolist(), found.tolist(), strict=True)]


def _class_logits(p: dict, hs: np.ndarray) -> np.ndarray:
    x = hs @ p["C"]
    x += p["cb"]
    return x


def _word_logits(p: dict, hs: np.ndarray, found: list[tuple[int, int, slice]]) -> np.ndarray:
    """Logits of the words of each row's class; rows in order of their class."""
    x = np.empty((len(hs), CLASS), dtype=hs.dtype)
    for a, b, rows in found:
        np.matmul(hs[a:b], p["O"][rows].T, out=x[a:b])
        x[a:b] += p["ob"][rows]
    return x


def _exps(logits: Callable[[], np.ndarray], at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(exponentials of each row of logits, their sum, the chosen place's logit); rows whose sum is out of range have their largest
    logit taken off first."""

    def made(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        chosen = x[np.arange(len(at)), at]
        with np.errstate(over="ignore"):
            np.exp(x, out=x)
            return x, x @ np.ones(x.shape[1], dtype=x.dtype), chosen

    out = made(logits())
    near = (out[1] > 1e-30) & (out[1] < 1e30)
    if not near.all():
        x = logits()
        x[~near] -= x[~near].max(axis=1, keepdims=True)
        out = made(x)
    return out


def log_probs(p: dict, hs: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Natural log of P(class) x P(word | class) of head words, of P(bucket) of others. hs: (n, HIDDEN)."""
    k = class_of(target)
    total, out = np.empty((2, len(hs)), dtype=hs.dtype)
    for a in range(0, len(hs), ROWS):
        w = slice(a, a + ROWS)
        _, total[w], out[w] = _exps(partial(_class_logits, p, hs[w]), k[w])
    out -= np.log(total)
    order, found = _by_class(k)
    _, total, chosen = _exps(partial(_word_logits, p, hs[order], found), target[order] % CLASS)
    out[order] += chosen - np.log(total)
    return out


def _errors(logits: Callable[[], np.ndarray], at: np.ndarray, on: np.ndarray) -> np.ndarray:
    """Softmax of each row of logits less one at its chosen place, times on."""
    x, total, _ = _exps(logits, at)
    x *= (on / total)[:, None]
    x[np.arange(len(at)), at] -= on
    return x


def gradients(p: dict, ids: np.ndarray, target: np.ndarray, fresh: np.ndarray, live: np.ndarray, h: np.ndarray) -> tuple[dict, np.ndarray]:
    """Gradients of the mean cross-entropy of one window, and the state after it. "E" is (words, gradients of their rows)."""
    n, g, kind = HIDDEN, {}, p["E"].dtype
    out, (gates, cs, was, us, starts) = forward(p, p["E"] @ p["Wx"] + p["b"], ids, fresh, h)
    hs, tg, on = out.reshape(-1, n), target.ravel(), live.ravel().astype(kind) / max(1, live.sum())
    on = on.astype(kind)
    k = class_of(tg)
    d = _errors(partial(_class_logits, p, hs), k, on)
    ones = np.ones(len(hs), dtype=kind)
    g["C"], g["cb"], dh = hs.T @ d, ones @ d, d @ p["C"].T
    g["O"], g["ob"] = np.zeros(SHAPES["O"], dtype=kind), np.zeros(HEAD, dtype=kind)
    order, found = _by_class(k)
    hso = hs[order]
    e, dho = _errors(partial(_word_logits, p, hso, found), tg[order] % CLASS, on[order]), np.empty_like(hso)
    for a, b, rows in found:
        np.matmul(e[a:b].T, hso[a:b], out=g["O"][rows])
        np.matmul(ones[a:b], e[a:b], out=g["ob"][rows])
        np.matmul(e[a:b], p["O"][rows], out=dho[a:b])
    dh[order] += dho
    dh = dh.reshape(out.shape)
    du, dx, (gate, *_) = _room(*ids.shape, n, kind)[4:]
    back, wh = np.zeros_like(dh[0]), np.ascontiguousarray(p["Wh"].T)
    for t in range(len(ids) - 1, -1, -1):
        z, r, c, dc, s = gates[t][:, :n], gates[t][:, n:], cs[t], dx[t][:, 2 * n :], dh[t]
        s += back
        kept = s * z
        np.subtract(s, kept, out=dc)
        dc -= dc * np.square(c)
        through = np.multiply(dc, r, out=du[t][:, 2 * n :])
        np.multiply(was[t] - c, kept, out=gate[:, :n])
        np.multiply(through, us[t][:, 2 * n :], out=gate[:, n:])
        gate *= 1 - gates[t]
        du[t][:, : 2 * n] = dx[t][:, : 2 * n] = gate
        back = du[t] @ wh
        back += kept
        if len(starts[t]):
            back[starts[t]] = 0
    du, dx = du.reshape(-1, 3 * n), dx.reshape(-1, 3 * n)
    g["Wh"], g["b"] = was.reshape(-1, n).T @ du, ones @ dx
    word, place = np.unique(ids, return_inverse=True)
    place, by_token = place.ravel(), dx @ p["Wx"].T
    g["Wx"] = p["E"][ids.ravel()].T @ dx
    g["E"] = word, np.stack([np.bincount(place, x, len(word)) for x in by_token.T], axis=1).astype(kind)
    return g, out[-1]


def lanes(docs: list[np.ndarray], count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Deal documents to lanes, longest first to the emptiest. Returns (steps, lanes) arrays: symbols, document numbers (-1 where
    a lane has ended), and whether a document starts."""
    count = min(count, max(1, len(docs)))
    load, dealt = [(0, k) for k in range(count)], [[] for _ in range(count)]
    heapify(load)
    for d in sorted(range(len(docs)), key=lambda i: -len(docs[i])):
        n, k = load[0]
        dealt[k].append(d)
        heapreplace(load, (n + len(docs[d]), k))
    steps = max(n for n, _ in load)
    ids, who, fresh = np.zeros((steps, count), dtype=np.int32), np.full((steps, count), -1, dtype=np.int32), np.zeros((steps, count), dtype=bool)
    for k, ds in enumerate(dealt):
        at = 0
        for d in ds:
            n = len(docs[d])
            ids[at : at + n, k], who[at : at + n, k], fresh[at, k] = docs[d], d, True
            at += n
    return ids, who, fresh


def inputs(ids: np.ndarray, fresh: np.ndarray, before: int | np.ndarray) -> np.ndarray:
    """What is read before each symbol: the one before it; where a document starts an end, or what `before` holds for each start."""
    out = np.vstack([np.zeros((1, ids.shape[1]), dtype=ids.dtype), ids[:-1]])
    out[fresh] = before
    return out


def train_on(p: dict, seen: dict, docs: list[np.ndarray], end: int) -> int:
    """AdaGrad over one pass of the documents, window by window with the state carried on; p and seen, the sums of squares, are
    changed in place. Returns the number of tokens."""
    pieces = [(d[k : k + PIECE], int(d[k - 1]) if k else end) for d in docs for k in range(0, len(d), PIECE)]
    ids, who, fresh = lanes([d for d, _ in pieces], LANES)
    read = inputs(ids, fresh, np.array([x for _, x in pieces], dtype=ids.dtype)[who[fresh]])
    h = np.zeros((ids.shape[1], HIDDEN), dtype=np.float32)
    for t in range(0, len(ids), STEPS):
        w = slice(t, t + STEPS)
        g, h = gradients(p, read[w], ids[w], fresh[w], who[w] >= 0, h)
        for k, x in g.items():
            rows = slice(None)
            if k == "E":
                rows, x = x
            np.clip(x, -1, 1, out=x)
            total = seen[k][rows] + x * x
            seen[k][rows] = total
            p[k][rows] -= RATE * x / np.sqrt(total)
    return int((who >= 0).sum())


def score_docs(p: dict, docs: list[np.ndarray], end: int) -> np.ndarray:
    """Natural log probability of each document's symbols, the state carried from its start to its end."""
    ids, who, fresh = lanes(docs, SCORE_LANES)
    read, h = inputs(ids, fresh, end), np.zeros((ids.shape[1], HIDDEN), dtype=np.float32)
    table_, out = p["E"] @ p["Wx"] + p["b"], np.zeros(len(docs))
    width = (who >= 0).sum(axis=0)
    order = np.argsort(-width, kind="stable")  # lanes that end first drop out
    ids, who, fresh, read, width = ids[:, order], who[:, order], fresh[:, order], read[:, order], width[order]
    for t in range(0, len(ids), SCORE_STEPS):
        on = int((width > t).sum())
        w = (slice(t, t + SCORE_STEPS), slice(0, on))
        hs, _ = forward(p, table_, read[w], fresh[w], h[:on], keep=False)
        h[:on] = hs[-1]
        owner = who[w].ravel()
        lp = log_probs(p, hs.reshape(-1, HIDDEN), ids[w].ravel())
        out += np.bincount(owner[owner >= 0], lp[owner >= 0], minlength=len(docs))
    return out


def _averaged(weights: DataFrame) -> np.ndarray | None:
    """Mean of the groups' numbers by their tokens. weights: (task, n, data); means of FAN_IN at a time, until few are left."""

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, total, n = None, None, 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([group], pa.int64()), pa.array([n], pa.int64()), pa.array([(total / n).astype("<f4").tobytes()], pa.binary())], ["task", "n", "data"])

        for b in batches:
            for task, k, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if group != task // FAN_IN:
                    if group is not None:
                        yield out()
                    group, total, n = task // FAN_IN, 0, 0
                total = total + k * np.frombuffer(data, dtype="<f4").astype(np.float64)
                n += k
        if group is not None:
            yield out()

    while weights.count() > FAN_IN:
        weights = save(weights.repartition(F.floor(F.col("task") / FAN_IN)).sortWithinPartitions("task").mapInArrow(mean, "task long, n long, data binary"), "mean")
    total, n = 0, 0
    for r in weights.orderBy("task").toLocalIterator():
        total, n = total + r["n"] * np.frombuffer(r["data"], dtype="<f4").astype(np.float64), n + r["n"]
    return (total / n).astype("<f4") if n else None


def coded(docs: DataFrame, hashes: np.ndarray, freq: np.ndarray, bucket_log: np.ndarray, base_log: float) -> DataFrame:
    """docs (id, held_out, text) -> CODED: each text is made into words once, and its symbols are kept for training and scoring. base and
    tails are logs of what is known of counts here, those of rare words are joined; key is a hash of the text."""
    shared = docs.sparkSession.sparkContext.broadcast((hashes, freq, bucket_log))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, freq, bucket_log = shared.value
        vocab, log1, known = Vocabulary(hashes), np.log10(freq + 1.0), freq > 0
        row = TaskContext.get().partitionId() << 32
        for b in batches:
            if not b.num_rows:
                continue
            size, at, h = coded_words(b.column(3))
            start = np.cumsum(size) - size
            codes = vocab.codes(h)
            symbols, _ = vocab.symbols(codes, h)
            there, rank = codes >= 0, np.maximum(codes, 0)
            logs = np.where(there, log1[rank], 0.0)
            tails = np.where(symbols >= HEAD, logs - bucket_log[np.maximum(symbols - HEAD, 0)], 0.0)
            other, heard = ~there[at], there & known[rank]
            rare = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.add.reduceat(other.astype(np.int64), start))].astype(np.int32)), pa.array(h[at[other]]))
            data, ends = symbols.astype("<u2")[at].tobytes(), [0, *(2 * (start + size)).tolist()]
            yield pa.RecordBatch.from_arrays([
                pa.array(row + np.arange(len(size))), *b.columns[:3], pa.array(size), pa.array(np.add.reduceat(heard[at].astype(np.int64), start)),
                pa.array(np.add.reduceat(logs[at], start) - size * base_log), pa.array(np.add.reduceat(tails[at], start)), rare, pa.array([data[i:j] for i, j in pairwise(ends)], pa.binary()),
            ], [x.split()[0] for x in CODED.split(", ")])
            row += len(size)

    return save(docs.select("id", "held_out", F.xxhash64("text").alias("key"), "text").mapInArrow(run, CODED), "coded")


def dealt(docs: DataFrame, size: int) -> DataFrame:
    """docs (key, symbols), of `size` bytes of text together -> (g, turn, lens, symbols): by group and round the symbols of its documents.
    A document's group, round and place there follow from its key, a hash of its text alone, whatever the partitions."""
    groups = max(1, -(-size // GROUP_BYTES))
    keyed = docs.select("symbols", F.pmod("key", F.lit(groups)).alias("g"), F.pmod(F.shiftright("key", 40), F.lit(ROUNDS)).cast("int").alias("turn"), "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def out() -> pa.RecordBatch:
            lens = np.array([len(x) // 2 for x in held], dtype="<i4")
            return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int64()), pa.array([at[1]], pa.int32()), pa.array([lens.tobytes()], pa.binary()), pa.array([b"".join(held)], pa.binary())], ["g", "turn", "lens", "symbols"])

        for b in batches:
            for symbols, g, turn in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and at != (g, turn):
                    yield out()
                    held = []
                at = (g, turn)
                held.append(symbols)
        if held:
            yield out()

    sorted_ = keyed.repartition("g").sortWithinPartitions("g", "turn", "key").select("symbols", "g", "turn")
    return save(sorted_.mapInArrow(run, "g long, turn int, lens binary, symbols binary"), "dealt")


def train(docs: DataFrame, hashes: np.ndarray, p: dict[str, np.ndarray], size: int) -> dict[str, np.ndarray]:
    """The weights after training on docs (text), of `size` bytes together."""
    one = docs.select(F.lit(None).cast("long").alias("id"), F.lit(False).alias("held_out"), "text")
    return train_coded(coded(one, hashes, np.ones(len(hashes)), np.zeros(BUCKETS), 0.0), hashes, p, size)


def train_coded(docs: DataFrame, hashes: np.ndarray, p: dict[str, np.ndarray], size: int) -> dict[str, np.ndarray]:
    """docs: CODED, of `size` bytes of text together: in each round every group trains on its next share of its documents, starting from
    the last round's mean weights and optimiser sums; the rounds' shares are disjoint and together all documents."""
    spark, end = docs.sparkSession, hashes[:HEAD].tolist().index(end_hash())
    work = dealt(docs, size)
    state = np.concatenate([np.frombuffer(pack_weights(p), dtype="<f4"), np.full(sum(int(np.prod(s)) for s in SHAPES.values()), 1e-8, dtype="<f4")])
    for turn in range(ROUNDS):
        shared = spark.sparkContext.broadcast(state.tobytes())

        def run(batches: Iterator[pa.RecordBatch], shared: object = shared) -> Iterator[pa.RecordBatch]:
            half = len(shared.value) // 2
            for b in batches:
                for g, lens, symbols in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    p, seen = unpack_weights(shared.value[:half]), unpack_weights(shared.value[half:])
                    ends = np.cumsum(np.frombuffer(lens, dtype="<i4"))
                    n = train_on(p, seen, np.split(np.frombuffer(symbols, dtype="<u2").astype(np.int32), ends[:-1]), end)
                    yield pa.RecordBatch.from_arrays([pa.array([g], pa.int64()), pa.array([n], pa.int64()), pa.array([pack_weights(p) + pack_weights(seen)], pa.binary())], ["task", "n", "data"])

        mine = work.where(F.col("turn") == turn).select("g", "lens", "symbols").repartition("g")
        got = _averaged(save(mine.mapInArrow(run, "task long, n long, data binary"), "weights"))
        state = state if got is None else got
    return unpack_weights(state[: len(state) // 2].astype("<f4").tobytes())


def score_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", mod: int = 7, rest: int = 2) -> DataFrame:
    """Score whole texts of df by a model learned from the rows whose crc32 of the id, as text, doesn't leave `rest` modulo `mod`.

    Returns one row per row of df: id_col, held_out, n_tokens (words and one end), n_known (tokens seen in training),
    train_tokens, base_score (log10 of the add-one unigram probability) and score (log10 of the model's probability; an
    unknown word is one outcome of its bucket). Null texts are empty: an end alone. Rows with a null id are
    learned from; repeated rows count and are scored once each; texts of any length are scored whole, with the state carried from
    their first word to their end; words of equal count are ranked by their hash; extra columns are ignored; an empty table gives no
    rows. The partitions of df don't matter but for the rounding of sums.
    """
    spark = session(df.sparkSession)
    out_ = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % mod == rest, F.lit(False))
    docs = df.select(F.col(id_col).cast("long").alias("id"), out_.alias("held_out"), F.col(text_col).alias("text"))
    learn = docs.where("not held_out").select("text")
    counts = save(count_words(learn), "counts")
    tidy(spark)
    by_bucket = counts.groupBy(F.col("h").bitwiseAND(BUCKETS - 1).alias("b")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    tokens, kinds = sum(r["n"] for r in by_bucket), sum(r["v"] for r in by_bucket)
    top = [(r["h"], r["n"]) for r in counts.orderBy(F.desc("n"), "h").limit(KNOWN).collect()]
    end = end_hash()
    if end not in {h for h, _ in top[:HEAD]}:
        top = [(end, dict(top).get(end, 0)), *[x for x in top if x[0] != end]]
    hashes, freq = np.array([h for h, _ in top], dtype=np.int64), np.array([n for _, n in top], dtype=np.int64)
    bucket = np.zeros((2, BUCKETS), dtype=np.int64)
    for r in by_bucket:
        bucket[:, r["b"]] = r["n"], r["v"]
    head = freq[:HEAD]
    np.subtract.at(bucket[0], hashes[:HEAD] & (BUCKETS - 1), head)
    np.subtract.at(bucket[1], hashes[:HEAD] & (BUCKETS - 1), (head > 0).astype(np.int64))
    size = learn.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    texts = coded(docs, hashes, freq, np.log10(bucket[0] + bucket[1] + 1), np.log10(tokens + kinds + 1))
    p = train_coded(texts.where("not held_out"), hashes, start_weights(head, bucket[0]), size)
    end_symbol = hashes[:HEAD].tolist().index(end)
    shared = spark.sparkContext.broadcast(pack_weights(p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = unpack_weights(shared.value)

        def out(held: list[tuple]) -> pa.RecordBatch:
            model = score_docs(p, [x[-1] for x in held], end_symbol) / np.log(10)
            *same, tails = list(zip(*held, strict=True))[:-1]
            kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64()]
            return pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(same, kinds, strict=True)), pa.array(model + np.array(tails))], NAMES)

        held, size = [], 0
        for b in batches:
            for *x, symbols in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.append((*x, np.frombuffer(symbols, dtype="<u2")))
                size += len(held[-1][-1])
                if size >= TOGETHER:
                    yield out(held)
                    held, size = [], 0
        if held:
            yield out(held)

    NAMES = ["row", "id", "held_out", "n_tokens", "n_known", "base", "score"]
    scored = save(texts.select(*NAMES[:-1], "tails", "symbols").mapInArrow(run, "row long, id long, held_out boolean, n_tokens long, n_known long, base double, score double"), "scored")
    tidy(spark)
    rare = texts.select("row", F.explode("rare").alias("h")).join(counts, "h", "left")
    more = rare.groupBy("row").agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + 1.0)).alias("s"), F.count("n").alias("k"))
    full = scored.join(more, "row", "left")
    s = F.coalesce("s", F.lit(0.0))
    return full.select(F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("k", F.lit(0))).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"), (F.col("base") + s).alias("base_score"), (F.col("score") + s).alias("score"))


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score_documents of the whole table `documents`."""
    return score_documents(table(spark, sf_dir, "documents"))
