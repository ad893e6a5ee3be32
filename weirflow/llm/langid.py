"""Language identification by interpolated Kneser-Ney character models in sorted hash arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirflow.llm.common import arrow_map, session, table

ORDER, DISCOUNT = 4, 0.75
#: The bound on the labelled sample that the models are fitted on: texts a language, and bytes a text.
FIT_TEXTS, FIT_BYTES = 160, 16_384
#: One text in so many of the sample only calibrates the rejection.
CALIBRATE = 4
#: Standard deviations above its language's mean cross-entropy at which a text is rejected.
REJECT_Z = 8.0
#: A text is never rejected for less than this many nats above the mean; text without a language's structure lies further off.
REJECT_NATS = 1.25
#: Characters beyond which more text no longer sharpens the score.
SCORE_CHARS = 40
#: Code points of the uniform distribution that ends the interpolation.
ALPHABET = 4096
#: Characters that are scored at once; a longer text is scored in parts.
PART = 1 << 19
U = np.uint64


def letter_table() -> np.ndarray:
    """By code point: what it counts as. Letters count as their lower case (where that is one character), all else as a space."""
    out = np.full(0x110000, 32, dtype=np.uint32)
    for c in range(0x110000):
        if (ch := chr(c)).isalpha():
            out[c] = ord(low) if len(low := ch.lower()) == 1 else c
    return out


def symbols(text: str, letters: np.ndarray) -> np.ndarray:
    """Letters in lower case with single spaces for what stands between them, and a space in front."""
    codes = letters[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    codes = np.concatenate([np.array([32], dtype=np.uint32), codes])
    return codes[~((codes == 32) & np.r_[False, codes[:-1] == 32])]


def grams(codes: np.ndarray, order: int = ORDER) -> list[np.ndarray]:
    """Hashes of the n-gram that ends at each position, n from 1; before the start are spaces."""
    x = codes.astype(U) * U(0xC2B2AE3D27D4EB4F)
    pad = np.zeros(1, dtype=U)
    out, prev = [], np.zeros(len(x), dtype=U)
    for n in range(order):
        before = np.concatenate([pad, prev[:-1]]) if n else prev
        g = before * U(0x9E3779B97F4A7C15) + x + U(n + 1)
        g = (g ^ (g >> U(31))) * U(0xBF58476D1CE4E5B9)
        prev = g ^ (g >> U(29))
        out.append(prev)
    return out


def find(keys: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, whether it is there) of each q in the sorted keys."""
    if not len(keys):
        return np.zeros(len(q), dtype=np.int64), np.zeros(len(q), dtype=bool)
    at = np.searchsorted(keys, q)
    at[at == len(keys)] = 0
    return at, keys[at] == q


@dataclass
class Model:
    langs: list[str]
    #: For n from 1: sorted hashes of the n-grams of all languages and, by language, the log probability of the last character.
    keys: list[np.ndarray]
    logp: list[np.ndarray]
    #: For n from 0: sorted hashes of contexts of n characters and, by language, the log weight of backing off from them.
    ctx: list[np.ndarray]
    back: list[np.ndarray]
    #: By language: mean cross-entropy, its spread between texts, and its spread for each character.
    mean: np.ndarray
    spread: np.ndarray
    noise: np.ndarray

    def log_probs(self, g: list[np.ndarray]) -> np.ndarray:
        """By position and language."""
        n_lang, size = len(self.langs), len(g[0])
        at, hit = find(self.keys[-1], g[-1])
        out = self.logp[-1][at]
        rest = np.flatnonzero(~hit)
        out[rest] = 0
        for n in range(len(g) - 1, -1, -1):  # `rest` has no (n + 1)-gram: weigh its context of n characters, then try n
            if not len(rest):
                break
            if n:
                ctx = np.where(rest > 0, g[n - 1][rest - 1], U(0))
                at, hit = find(self.ctx[n], ctx)
                out[rest[hit]] += self.back[n][at[hit]]
                at, hit = find(self.keys[n - 1], g[n - 1][rest])
                out[rest[hit]] += self.logp[n - 1][at[hit]]
                rest = rest[~hit]
            else:
                out[rest] += self.back[0][0] - np.log(ALPHABET)
        return out.reshape(size, n_lang)


def fit(samples: dict[str, list[str]], order: int = ORDER, discount: float = DISCOUNT) -> Model:
    """Models of all languages of the sample; some texts of each are left out of its counts and calibrate its rejection."""
    letters, langs = letter_table(), sorted(samples)
    kept = {k: [t for i, t in enumerate(samples[k]) if len(samples[k]) < CALIBRATE or i % CALIBRATE] for k in langs}
    own = {}
    for k in langs:
        parts = [np.concatenate([np.full(order, 32, dtype=np.uint32), symbols(t, letters)]) for t in kept[k]]
        g = [np.concatenate(x) for x in zip(*[[y[order:] for y in grams(p, order)] for p in parts], strict=True)] if parts else []
        before = [np.concatenate(x) for x in zip(*[[y[order - 1 : -1] for y in grams(p, order)] for p in parts], strict=True)] if parts else []
        own[k] = (g, before)
    keys, rep = [], []  # of each order: hashes, and of each its context and its suffix
    for n in range(order):
        hashes = np.concatenate([own[k][0][n] for k in langs])
        u, at = np.unique(hashes, return_index=True)
        ctx = np.concatenate([own[k][1][n - 1] for k in langs])[at] if n else np.zeros(len(u), dtype=U)
        suffix = np.concatenate([own[k][0][n - 1] for k in langs])[at] if n else np.zeros(len(u), dtype=U)
        keys.append(u)
        rep.append((ctx, suffix))
    contexts = [np.unique(rep[n][0]) for n in range(order)]
    logp = [np.zeros((len(k), len(langs)), dtype=np.float64) for k in keys]
    back = [np.zeros((len(c), len(langs)), dtype=np.float64) for c in contexts]
    for j, k in enumerate(langs):
        counts: list[np.ndarray] = [np.zeros(0)] * order
        counts[-1] = np.bincount(np.searchsorted(keys[-1], own[k][0][-1]), minlength=len(keys[-1])).astype(float)
        for n in range(order - 2, -1, -1):  # lower orders count the characters that an n-gram follows
            seen = counts[n + 1] > 0
            counts[n] = np.bincount(np.searchsorted(keys[n], rep[n + 1][1][seen]), minlength=len(keys[n])).astype(float)
        lower = np.full(1, 1 / ALPHABET)
        for n in range(order):
            ctx = np.searchsorted(contexts[n], rep[n][0])
            total = np.bincount(ctx, counts[n], len(contexts[n]))
            kinds = np.bincount(ctx, counts[n] > 0, len(contexts[n]))
            weight = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
            below = lower[np.searchsorted(keys[n - 1], rep[n][1])] if n else lower[np.zeros(len(keys[0]), dtype=int)]
            p = np.maximum(counts[n] - discount, 0) / np.maximum(total, 1)[ctx] + weight[ctx] * below
            logp[n][:, j], back[n][:, j], lower = np.log(p), np.log(weight), p
    small = lambda xs: [x.astype(np.float32) for x in xs]
    model = Model(langs, keys, small(logp), contexts, small(back), *np.zeros((3, len(langs))))
    for j, k in enumerate(langs):
        test = [t for i, t in enumerate(samples[k]) if len(samples[k]) < CALIBRATE or i % CALIBRATE == 0]
        got = [(n, -s[j] / n) for t in test for s, n in [score_text(model, t, letters)] if n]
        if not got:
            model.mean[j], model.spread[j], model.noise[j] = np.log(ALPHABET), 0, 0
            continue
        n, ce = np.array(got).T
        mean = np.average(ce, weights=n)
        long = n >= np.median(n)
        model.mean[j], model.spread[j] = mean, np.sqrt(np.mean((ce[long] - mean) ** 2))
        model.noise[j] = np.sqrt(np.mean(n * (ce - mean) ** 2))
    return model


def score_text(model: Model, text: str, letters: np.ndarray) -> tuple[np.ndarray, int]:
    """(log likelihood by language, characters scored); no characters if the text has no letter."""
    codes = symbols(text, letters)
    if not model.langs or not (codes != 32).any():
        return np.zeros(len(model.langs)), 0
    total, pad = np.zeros(len(model.langs)), np.full(ORDER, 32, dtype=np.uint32)
    for k in range(0, len(codes), PART):
        part = np.concatenate([pad, codes[k : k + PART]])
        total += model.log_probs(grams(part))[ORDER:].sum(axis=0, dtype=np.float64)
        pad = part[-ORDER:]
    return total, len(codes)


def judge(model: Model, total: np.ndarray, n: int) -> tuple[str, float, float, bool]:
    """(language, score, cross-entropy a character, whether rejected) of a text's log likelihoods."""
    if not n:
        return "und", 0.0, 0.0, True
    ce = -total / n
    j = int(np.argmin(ce))
    p = np.exp(-(ce - ce[j]) * min(n, SCORE_CHARS))
    limit = model.mean[j] + max(REJECT_NATS, REJECT_Z * np.sqrt(model.spread[j] ** 2 + model.noise[j] ** 2 / n))
    return model.langs[j], float(p[j] / p.sum()), float(ce[j]), bool(ce[j] > limit)


def sample(df: DataFrame, where: Column, id_col: str, text_col: str, lang_col: str, texts: int = FIT_TEXTS, size: int = FIT_BYTES) -> dict[str, list[str]]:
    """At most `texts` texts of at most `size` bytes of each language, by least hash. Languages are thinned by their counts
    first, so that no task gathers a language."""
    rows = df.where(where & F.col(lang_col).isNotNull() & F.octet_length(text_col).between(1, size)).select(F.col(lang_col).alias("lang"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("h"), F.col(text_col).alias("text"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return {}
    share = {k: min(1.0, (2 * texts + 50) / c) for k, c in counts.items()}
    lim = F.create_map(*[x for k, s in share.items() for x in (F.lit(k), F.lit(s * (1 << 30)))])[F.col("lang")]
    thin = rows.where(F.pmod("h", F.lit(1 << 30)) < lim)
    top = thin.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).where(F.col("k") <= texts)
    out: dict[str, list[str]] = {}
    for r in top.orderBy("lang", "k").select("lang", "text").collect():
        out.setdefault(r["lang"], []).append(r["text"])
    return out


def identify(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Add lang_pred, lang_score (0 to 1), lang_ce (nats a character) and lang_rejected to the rows of df.

    Only the text is read, whole. Null texts and texts without a letter are `und` with score 0 and rejected; a text is also
    rejected if its cross-entropy lies far above what its language's calibration texts have. Columns of these names
    are replaced; repeated rows get equal results; an empty table gives no rows.
    """
    shared = session(df.sparkSession).sparkContext.broadcast(vars(model))
    names = ["lang_pred", "lang_score", "lang_ce", "lang_rejected"]
    keep = [c for c in df.columns if c not in names]
    df = df.select(*keep)
    at = keep.index(text_col)
    ready: list = []

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        if not ready:
            ready.extend([Model(**shared.value), letter_table()])
        m, letters = ready
        got = [judge(m, *score_text(m, t, letters)) if t else judge(m, np.zeros(1), 0) for t in b.column(at).to_pylist()]
        cols = [pa.array(c, k) for c, k in zip(zip(*got, strict=True), (pa.string(), pa.float64(), pa.float64(), pa.bool_()), strict=True)]
        return pa.RecordBatch.from_arrays([*b.columns, *cols], [*keep, *names])

    added = zip(names, (T.StringType(), T.DoubleType(), T.DoubleType(), T.BooleanType()), strict=True)
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, t) for n, t in added)])
    return arrow_map(df, run, schema)


def held_out(id_col: str, mod: int, rest: int) -> Column:
    """Whether crc32 of the id as text leaves `rest`; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % mod == rest, F.lit(False))


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", mod: int = 5, rest: int = 0) -> Model:
    """Fit on a bounded sample of the labelled rows that aren't held out. Without any, the model has no language and all texts
    are `und`."""
    got = sample(df, ~held_out(id_col, mod, rest), id_col, text_col, lang_col)
    return fit(got) if got else Model([], [], [], [], [], *np.zeros((3, 0)))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text of `documents`, learned from the labelled rows that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs.select("doc_id", "text", "lang"))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_ce").alias("cross_entropy"), F.col("lang_rejected").alias("rejected"))
