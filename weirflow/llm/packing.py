"""Hierarchical packing of tokenised documents into windows of several lengths."""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.llm.common import session, table

#: Window lengths, shortest first; each is a power of two, so a full window of any tier needs no padding.
TIERS = (256, 512, 1024, 2048)
#: Tokens that a task gathers before it packs them; what is left over goes on to the next round.
ROUND_TOKENS = 1 << 20
#: Tokens of one optimiser step; windows are dealt to step groups so that each has nearly as many.
STEP_TOKENS = 1 << 16
#: Sequence numbers of one task start at its partition number times this.
PER_TASK = 1 << 40
#: Distinct space-separated chunks whose ids a task remembers, and characters of text that it splits at once.
REMEMBERED, SPLIT = 600_000, 1 << 20
#: Letters that Python and the tokenizer may lower differently.
UNUSUAL = re.compile(r"[^\x00-\u024f\u1e00-\u1eff\u2000-\u206f]|\u0130")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def chunks(text: str) -> list[str]:
    """The text between spaces, in lower case as the tokenizer has it; a full stop or comma that ends a word is a chunk of its own,
    as it is a token, so fewer chunks are new."""
    text = text.replace("\n", " ")
    if text.isascii() or not UNUSUAL.search(text):
        text = text.lower()
        for mark in (".", ","):
            parts = text.split(f"{mark} ")
            if all(p[-1:].isalnum() for p in parts[:-1]):  # else the mark may be one token with what stands before it
                text = f" {mark} ".join(parts)
    return text.split(" ")


class Ids(dict):
    """Chunk -> its ids as little-endian unsigned 32-bit integers. The tokenizer drops white space and never joins words
    across it, so a text's ids are those of its chunks between spaces, one after another. Chunks not met before are encoded
    together, as words of one sequence."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__({"": b""})
        self.tok = Tokenizer.from_file(path)

    @staticmethod
    def here(path: str) -> Ids:
        """This Python worker's, which outlives the task: it hangs on an imported module, as this one travels by value."""
        import tokenizers

        kept = vars(tokenizers).setdefault("_ids_by_path", {})
        if path not in kept:
            kept[path] = Ids(path)
        return kept[path]

    def learn(self, chunks: list[str]) -> None:
        got = self.tok.encode(chunks, is_pretokenized=True, add_special_tokens=False)
        ids, word = np.array(got.ids, dtype="<u4"), np.array(got.word_ids, dtype=np.int64)
        ends = 4 * np.searchsorted(word, np.arange(len(chunks) + 1))
        data = ids.tobytes()
        self.update(zip(chunks, [data[x:y] for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], strict=True))

    def of(self, texts: list[str | None], end: bytes) -> list[bytes]:
        # "<|" may begin a special token's name, which can hold what chunks don't show: such a text is encoded as it is.
        odd = [i for i, t in enumerate(texts) if t and "<|" in t]
        split = [[] if not t or "<|" in t else chunks(t) for t in texts]
        if len(self) > REMEMBERED:
            self.clear()
            self[""] = b""
        found = [list(map(self.get, x)) for x in split]
        short = [i for i, x in enumerate(found) if None in x]
        if short:
            self.learn(sorted({c for i in short for c, v in zip(split[i], found[i], strict=True) if v is None}))
            for i in short:
                found[i] = [self[c] if v is None else v for c, v in zip(split[i], found[i], strict=True)]
        out = [b"".join(x) + end for x in found]
        for i in odd:
            out[i] = np.array(self.tok.encode(texts[i], add_special_tokens=False).ids, dtype="<u4").tobytes() + end
        return out


def together(rows: Iterable[tuple]) -> Iterator[list[tuple]]:
    """Lists of rows (doc, text) of at least SPLIT characters, but for the last."""
    some, size = [], 0
    for r in rows:
        some.append(r)
        size += len(r[1] or "")
        if size >= SPLIT:
            yield some
            some, size = [], 0
    if some:
        yield some


class Pieces:
    """Pieces of documents of one tier: longest first out, or the longest that fits a gap."""

    def __init__(self) -> None:
        self.sizes: list[tuple[int, int]] = []
        self.held: dict[int, tuple] = {}
        self.n = 0

    def add(self, piece: tuple) -> None:
        self.n += 1
        self.held[self.n] = piece
        insort(self.sizes, (piece[2], -self.n))

    def fit(self, gap: int) -> tuple | None:
        k = bisect_right(self.sizes, (gap, 0))
        return self.held.pop(-self.sizes.pop(k - 1)[1]) if k else None

    def longest(self) -> tuple | None:
        return self.held.pop(-self.sizes.pop()[1]) if self.sizes else None


def pack(docs: list[tuple], tiers: tuple[int, ...] = TIERS, final: bool = True) -> tuple[list[tuple[int, list[tuple]]], list[tuple]]:
    """Pack pieces (doc, start, length) into windows.

    Returns the windows, (length, pieces), and the pieces left over (none if final). Pieces over the longest tier are cut
    into full windows first; each remainder goes to the shortest tier that holds it. From the longest tier down, a window
    takes the longest piece of its tier, then fills its gap with the longest fitting pieces of this and shorter tiers,
    and at last with the start of a piece that doesn't fit, whose rest is routed again. If final, what can't fill
    a window of its tier is cut into windows of smaller powers of two, so no window needs padding.
    """
    top, windows = tiers[-1], []
    by_tier = {t: Pieces() for t in tiers}

    def route(p: tuple) -> None:
        by_tier[next(t for t in tiers if t >= p[2])].add(p)

    for d, s, n in docs:
        while n >= top:
            windows.append((top, [(d, s, top)]))
            s, n = s + top, n - top
        if n:
            route((d, s, n))
    for i in range(len(tiers) - 1, -1, -1):
        t, shorter = tiers[i], tiers[: i + 1]
        held = lambda: sum(sum(x for x, _ in by_tier[u].sizes) for u in shorter)
        left = held()
        while by_tier[t].sizes and left >= t:
            got, gap = [by_tier[t].longest()], t
            gap -= got[0][2]
            while gap:
                p = next((p for u in reversed(shorter) if (p := by_tier[u].fit(gap))), None)
                if p is None:
                    d, s, n = next(p for u in shorter if (p := by_tier[u].longest()))
                    p = (d, s, gap)
                    route((d, s + gap, n - gap))
                got.append(p)
                gap -= p[2]
            windows.append((t, got))
            left -= t
        if i:  # what doesn't fill a window of this tier is cut for the next one down
            while (p := by_tier[t].longest()) is not None:
                d, s, n = p
                half = tiers[i - 1]
                while n >= half:
                    windows.append((half, [(d, s, half)]))
                    s, n = s + half, n - half
                if n:
                    route((d, s, n))
    rest = []
    while (p := by_tier[tiers[0]].longest()) is not None:
        rest.append(p)
    if not final:
        return windows, rest
    total = sum(p[2] for p in rest)
    while total:
        size, got = 1 << total.bit_length() - 1, []
        gap = size
        while gap:
            d, s, n = rest.pop()
            k = min(n, gap)
            got.append((d, s, k))
            if n > k:
                rest.append((d, s + k, n - k))
            gap -= k
        windows.append((size, got))
        total -= size
    return windows, []


class Steps:
    """Deals windows to step groups: the next window joins the open group of fewest tokens, and full groups close."""

    def __init__(self, tokens: int, at_once: int = 4):
        self.tokens, self.open, self.next = tokens, [[0, k] for k in range(at_once)], at_once

    def take(self, length: int) -> int:
        g = min(self.open)
        k = g[1]
        g[0] += length
        if g[0] >= self.tokens:
            g[0], g[1] = 0, self.next
            self.next += 1
        return k


def pack_documents(df: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """Tokenise and pack all rows of df; every id lies in exactly one piece.

    Returns one row per piece: id_col, start, length, ids_crc32 (of the piece's ids as little-endian unsigned 32-bit
    integers), doc_tokens, sequence_id, offset, window (the sequence's length, a power of two of at most the longest
    tier, always filled) and step_group. Null and empty texts are the end id alone; texts of any length are cut; a null id is
    carried; repeated rows are packed once each; extra columns are ignored; an empty table gives no rows. Tasks pack
    what they read, round by round, without a shuffle, so memory doesn't follow the input.
    """
    session(df.sparkSession)
    path = tokenizer or default_tokenizer()
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "window", "step_group"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, end = Ids.here(path), np.array([end_id], dtype="<u4").tobytes()
        first = TaskContext.get().partitionId() * PER_TASK
        steps, seq = Steps(STEP_TOKENS), 0
        docs: dict[int, tuple] = {}
        pieces: list[tuple] = []
        waiting, n = 0, 0

        def flush(final: bool) -> pa.RecordBatch:
            nonlocal seq, pieces, waiting, docs
            windows, pieces = pack(pieces, tiers, final)
            rows = []
            for size, got in windows:
                group, at = steps.take(size), 0
                for d, s, k in got:
                    doc, data, base = docs[d]
                    rows.append((doc, s, k, zlib.crc32(memoryview(data)[4 * (s - base) : 4 * (s - base + k)]), docs_len[d], first + seq, at, size, first + group))
                    at += k
                seq += 1
            left = {p[0] for p in pieces}
            docs = {d: x for d, x in docs.items() if d in left}
            for d in [d for d in docs_len if d not in left]:
                del docs_len[d]
            waiting = sum(p[2] for p in pieces)
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

        docs_len: dict[int, int] = {}
        rows = ((doc, text) for b in batches for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        for some in together(rows):
            for (doc, _), data in zip(some, ids.of([x for _, x in some], end), strict=True):
                n += 1
                docs[n], docs_len[n] = (doc, data, 0), len(data) // 4
                pieces.append((n, 0, docs_len[n]))
                waiting += docs_len[n]
                if waiting >= ROUND_TOKENS:
                    yield flush(False)
        if pieces:
            yield flush(True)

    schema = f"`{id_col}` long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, window int, step_group long"
    return df.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("text")).mapInArrow(run, schema)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pack_documents of the whole table `documents`."""
    return pack_documents(table(spark, sf_dir, "documents"))
