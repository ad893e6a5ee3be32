"""From raw documents to packed sequences: language, lines, near copies, benchmark leaks, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.llm.common import save, table
from weirflow.llm.decontaminate import clean
from weirflow.llm.langid import identify, train
from weirflow.llm.line_dedup import dedup_lines
from weirflow.llm.packing import pack_documents
from weirflow.llm.simhash_wide import drop_near_copies


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is rejected go (null, no letters, or unlike every language); the rest, repeated rows too, stay as they
    are. Texts are read whole."""
    return identify(docs, train(docs)).where("not lang_rejected").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar lines only the first stays, by the least id and number, null ids last; n_chars follows the text. Rows of
    equal id and text are one text and lose the same lines."""
    return dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, by SimHash of five-word shingles verified at a similarity of 0.8 or more, the document of the least
    id stays; null ids come last, and of repeated rows one stays."""
    return drop_near_copies(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item or a paraphrase go, each judged by its own text; null and empty texts stay."""
    return clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of up to 2048 tokens. Null and empty texts are their end alone, repeated rows are
    documents of their own, and very long texts are cut into pieces."""
    return pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("line_dedup", lines),
    ("simhash_dedup", near_copies),
    ("decontamination", decontaminated),
    ("packing", packed),
]

#: No stage can be said in SQL on whole tables: trained models, similarities of all pairs, a tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table `documents`, each on what the one before has written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
