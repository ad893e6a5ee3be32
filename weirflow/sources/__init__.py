"""Where record streams come from: files of text, CSV and JSON lines, standard input, and tables."""

from __future__ import annotations

import re
import sys
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirflow.records import ERROR, ORDER, VALUE, Stream, from_values

#: A list of files up to this long is broadcast; a longer one is joined by shuffle.
FILES = 100_000


def _null() -> Column:
    return F.lit(None).cast("string")


def _numbered(df: DataFrame) -> DataFrame:
    """df with `_f`, the place of each row's file among the paths in their order. Only the list of paths is ranked; it is on the driver
    anyway, which has listed the files."""
    plain = lambda p: re.sub("^file:/+", "/", p)  # noqa: E731 - the two lists spell local paths differently
    paths = sorted({plain(p) for p in df.inputFiles()})
    if len(paths) <= 1:
        return df.withColumn("_f", F.lit(0).cast("long"))
    places = df.sparkSession.createDataFrame([(p, i) for i, p in enumerate(paths)], "_path string, _at long")
    df = df.withColumn("_path", F.regexp_replace("_path", "^file:/+", "/"))
    found = df.join(F.broadcast(places) if len(paths) <= FILES else places, "_path", "left")
    return found.withColumn("_f", F.coalesce("_at", F.raise_error(F.concat(F.lit("not among the listed files: "), F.col("_path"))).cast("long"))).drop("_at")


def file(spark: SparkSession, path: str, binary: bool = False) -> Stream:
    """Each file whole as one value, in the order of paths."""
    if binary:
        df = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("_path"), F.col("content").alias(VALUE))
    else:
        df = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("_path"), F.col("value").alias(VALUE))
    return Stream(_numbered(df).select(F.array("_f").alias(ORDER), VALUE, _null().alias(ERROR)))


def stdin(spark: SparkSession, text: str | None = None) -> Stream:
    """What the driver reads from standard input, as one value."""
    return from_values(spark, [sys.stdin.read() if text is None else text])


def text_lines(spark: SparkSession, path: str) -> Stream:
    """One record a line, ordered by file, by the place of the split that holds it, and by its place there: large files are read in
    parallel, and no task sees a file whole. A carriage return at the end of a line isn't part of it."""
    df = spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").cast("long").alias("_b"),
        F.monotonically_increasing_id().alias("_i"), F.regexp_replace("value", "\r$", "").alias(VALUE),
    )
    return Stream(_numbered(df).select(F.array("_f", "_b", "_i").alias(ORDER), VALUE, _null().alias(ERROR)))


def _quotes() -> Column:
    return F.length(VALUE) - F.length(F.replace(F.col(VALUE), F.lit('"'), F.lit("")))


def _tops(s: Stream) -> DataFrame:
    """The first line of each file: `_f` and its order key and text as `_top`."""
    first = s.df.where(F.element_at(ORDER, 2) == 0)
    return first.groupBy(F.element_at(ORDER, 1).alias("_f")).agg(F.min(F.struct(F.col(ORDER).alias("o"), F.col(VALUE).alias("v"))).alias("_top"))


def _joined_lines(s: Stream) -> Stream:
    """Lines put together where a quoted cell holds line feeds. A file with such cells is read in one task, as whether a quote opens or
    closes depends on all before it."""
    by_file = Window.partitionBy(F.element_at(ORDER, 1)).orderBy(ORDER)
    before = F.coalesce(F.sum(_quotes()).over(by_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    df = s.df.withColumn("_s", F.when(before % 2 == 0, F.col(ORDER)))
    df = df.withColumn("_s", F.last("_s", ignorenulls=True).over(by_file))
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.col(ORDER).alias("o"), F.col(VALUE).alias("v")))), lambda x: x["v"])
    got = df.groupBy("_s").agg(F.array_join(lines, "\n").alias(VALUE))
    return replace(s, df=got.select(F.col("_s").alias(ORDER), VALUE, _null().alias(ERROR)))


def csv(spark: SparkSession, path: str, header: bool = False, raw: bool = False, sep: str = ",", columns: int | None = None) -> Stream:
    """Cells by column: names of the header (the first line of each file, by the first file's), else 0, 1, ... A column
    whose cells are all whole numbers is of integers, else of strings; a short row ends in nulls, an empty last cell is "", and
    cells beyond the header go. raw: quotes mean nothing. A quoted cell may hold separators, doubled quotes and line feeds.

    Jobs run here: one that finds kinds, width and open quotes together, and one for the header."""
    s = text_lines(spark, path)
    esc = "\\" + sep if not sep.isalnum() and sep != "\t" else sep

    def cells() -> Column:
        if raw:
            return F.split(F.col(VALUE), esc, -1)
        each = F.regexp_extract_all(F.concat(F.col(VALUE), F.lit(sep)), F.lit(rf'("(?:[^"]|"")*"|[^{esc}]*){esc}'), F.lit(1))
        return F.transform(each, lambda c: F.when(c.startswith('"'), F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c))

    def seen(s: Stream) -> tuple:
        df = s.df
        if header:
            tops = _tops(s).select(F.element_at("_top.o", 1).alias("_f"), F.element_at("_top.o", 3).alias("_i"))
            place = df.withColumns({"_f": F.element_at(ORDER, 1), "_i": F.element_at(ORDER, 3)})
            df = place.join(F.broadcast(tops) if len(df.inputFiles()) <= FILES else tops, ["_f", "_i"], "left_anti").drop("_f", "_i")
        df = df.withColumn("_c", cells())
        # For each place whether some row has a cell there, and whether some cell there is no whole number.
        places = F.transform("_c", lambda c, i: F.struct(i.alias("i"), (~c.rlike(r"^-?[0-9]{1,18}\z")).alias("text")))
        odd = F.lit(False) if raw else _quotes() % 2 == 1
        return df, df.agg(F.max(F.size("_c")).alias("n"), F.array_distinct(F.flatten(F.collect_set(places))).alias("places"), F.bool_or(odd).alias("odd")).collect()[0]

    df, row = seen(s)
    if row["odd"]:
        s = _joined_lines(s)
        df, row = seen(s)
    if header:
        first = _tops(s).orderBy("_f").limit(1).select(F.col("_top.v").alias(VALUE)).withColumn("_c", cells()).collect()
        names = list(first[0]["_c"]) if first else []
    else:
        names = [str(i) for i in range(columns or row["n"] or 0)]
    some, texts = {x["i"] for x in row["places"] or []}, {x["i"] for x in row["places"] or [] if x["text"]}
    # A place that no row fills, or a row too short for it, leaves nulls; those don't decide its kind.
    cols = [F.get("_c", F.lit(i)) for i in range(len(names))]
    cols = [c.cast("long") if i in some and i not in texts else c for i, c in enumerate(cols)]
    out = df.select(ORDER, _null().alias(VALUE), _null().alias(ERROR), *[c.alias(f"n_{n}") for n, c in zip(names, cols, strict=True)])
    return Stream(out, {n: f"n_{n}" for n in names}, undefined=True)


def jsonl(spark: SparkSession, path: str, objects: bool = False, use_null: bool = False) -> Stream:
    """One JSON value a line. Objects spread to columns by key, unless `objects` keeps them whole; other values are the current
    column. Values of several kinds keep theirs, as VARIANT. A line that isn't JSON is an error value, and the rest is read on; blank
    lines are none. use_null: gaps are null rather than undefined."""
    s = text_lines(spark, path)
    s = replace(s, df=s.df.where(~F.col(VALUE).rlike(r"^\s*\z")))
    parsed = F.try_parse_json(VALUE)
    bad = parsed.isNull() & F.col(VALUE).isNotNull()
    schema = s.df.agg(F.schema_of_variant_agg(parsed).alias("t")).collect()[0]["t"] or "VOID"
    t = "variant" if schema in ("VOID", "VARIANT") else schema.replace("OBJECT<", "STRUCT<")
    value = parsed if t == "variant" else F.variant_get(parsed, "$", t)
    df = s.df.withColumns({ERROR: F.when(bad, F.concat(F.lit("invalid JSON: "), F.col(VALUE))), "_x": F.when(~bad, value)})
    s = replace(s, df=df.withColumn(VALUE, F.col("_x")).drop("_x"))
    kind = s.type_of(VALUE)
    if objects or not isinstance(kind, T.StructType):
        return s
    names = {f.name: f"n_{f.name}" for f in kind.fields}
    df = s.df.select(ORDER, _null().alias(VALUE), ERROR, *[F.col(VALUE)[n].alias(c) for n, c in names.items()])
    return replace(s, df=df, names=names, undefined=not use_null)
