"""Shared pieces of the corpus operators: tables in the shared folder, Arrow batches, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.storage import new_path

#: Rows in an Arrow batch sent to a Python worker; texts are long, so batches stay short.
ARROW_ROWS = 512

#: ASCII capitals and what they become; other letters keep their case.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def session(spark: SparkSession) -> SparkSession:
    """Short Arrow batches, so that a worker's memory doesn't follow the length of texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark


def save(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it again: cuts the lineage and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return session(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema) -> DataFrame:
    """mapInArrow with one output batch (or none) for an input batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                out = fn(b)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def components(links: DataFrame) -> DataFrame:
    """Connected components of `links` (a long, b long): one row (node, root) for every node that has a link to
    another node; root is some node of the component, the same for all of it.

    Randomised contraction: every node hooks onto the neighbour (or itself) that comes first in an order that is
    hashed anew each round, links are relabelled, and the rounds end when no link is left. Only aggregates with
    map-side combining and equi-joins on node ids, so a hub neither gathers its neighbours nor emits pairs of them;
    each round is a table in the shared folder. Null ends and self-links are ignored.
    """
    spark = links.sparkSession
    edges = save(
        links.where("a is not null and b is not null and a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct(),
        "links",
    )
    labels = None
    for turn in range(200):
        if edges.isEmpty():
            break
        order = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("h"), F.col(c).alias("n"))
        both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
        hooks = save(
            both.groupBy(F.col("a").alias("node")).agg(F.min(order("b")).alias("m"))
            .select("node", F.least(order("node"), F.col("m")).getField("n").alias("root")),
            "hooks",
        )
        if labels is None:
            labels = hooks
        else:
            step = hooks.select(F.col("node").alias("root"), F.col("root").alias("next"))
            labels = save(labels.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "labels")
        one = hooks.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        two = hooks.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        half = edges.join(one, "a").select("ra", "b")
        edges = save(
            half.join(two, "b").where("ra <> rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(),
            "links",
        )
    if labels is None:
        return spark.createDataFrame([], "node long, root long")
    return labels


#: The place of a null id: after all others.
LAST = (1 << 63) - 1


def keyed(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows, distinct rows) of df as (id, doc, tie, data, rest): doc orders ids, nulls last; data is the text's UTF-8 bytes, null as
    empty; (doc, tie) tells different texts apart. tie is 0 unless an id repeats, then a hash of the text; equal rows stay equal.
    rest (only in rows) holds the other columns."""
    doc = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST))
    text = F.coalesce(F.col(text_col), F.lit(""))
    again = not df.groupBy(doc.alias("doc")).count().where("count > 1").isEmpty()
    tie = F.xxhash64(text) if again else F.lit(0).cast("long")
    others = [F.col(c) for c in df.columns if c not in (id_col, text_col)] or [F.lit(0).alias("none")]
    rows = df.select(F.col(id_col).cast("long").alias("id"), doc.alias("doc"), tie.alias("tie"), text.cast("binary").alias("data"), F.struct(*others).alias("rest"))
    one = rows.select("doc", "tie", "data")
    return rows, one.dropDuplicates(["doc", "tie"]) if again else one


def tidy(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of steps whose results are saved, which else stay until the driver collects garbage."""
    spark._jvm.System.gc()


def unused(df: DataFrame, *names: str) -> list[str]:
    """names, each made longer until df has no column of that name (Spark doesn't tell upper from lower case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out
