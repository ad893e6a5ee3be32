"""Record streams: a DataFrame with an order, groups, a current column and an error column.

Every operator is a function from stream to stream that adds to the lazy plan. Columns of the frame: `_o` array<bigint>, the
order key (children append to their parent's); `_g1`, `_g2`, ... the key of each open group level; `_v` the current value;
`_e` its error message, null for none; and the named columns.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirflow.functions.expressions import Value, as_variant, typed_value

ORDER, VALUE, ERROR = "_o", "_v", "_e"
#: Order keys sampled for each piece that the root stream is cut into for ranking.
SAMPLED = 64
#: Pieces at most, as their cuts are part of the plan.
MOST_PIECES = 512


@dataclass(frozen=True)
class Stream:
    df: DataFrame
    names: dict[str, str] = field(default_factory=dict)
    #: One frame of group keys (and first rows) for each open level; None where no record can have gone since it was opened.
    frames: tuple = ()
    atoms: dict[str, Any] = field(default_factory=dict)
    undefined: bool = False

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    @property
    def level(self) -> int:
        return len(self.frames)

    @property
    def groups(self) -> list[str]:
        return [f"_g{i + 1}" for i in range(self.level)]

    def type_of(self, col: str) -> T.DataType:
        return self.df.schema[col].dataType

    def lookup(self, name: str) -> Value | None:
        """A column by name; `_` is the current one."""
        if name == "_":
            return Value(F.col(VALUE), "undefined", F.col(ERROR)) if self.undefined else typed_value(F.col(VALUE), self.type_of(VALUE), F.col(ERROR))
        col = self.names.get(name)
        return None if col is None else typed_value(F.col(f"`{col}`"), self.type_of(col))

    def with_value(self, value: Column, error: Column | None = None, keep_error: bool = True) -> Stream:
        """A new current value. Errors of the old one pass on."""
        new = F.lit(None).cast("string") if error is None else error
        err = F.coalesce(F.col(ERROR), new) if keep_error else new
        df = self.df.withColumns({"_nv": value, "_ne": err})
        df = df.withColumns({VALUE: F.col("_nv"), ERROR: F.col("_ne")}).drop("_nv", "_ne")
        return replace(self, df=df, undefined=False)

    def where(self, cond: Column) -> Stream:
        return replace(self.remember(), df=self.df.where(cond))

    def remember(self) -> Stream:
        """Before records can go: keep the group frames, so that groups left empty are still there."""
        if all(f is not None for f in self.frames):
            return self
        frames = []
        for i, f in enumerate(self.frames):
            keys = self.groups[: i + 1]
            frames.append(f if f is not None else self.df.groupBy(*keys).agg(F.min(ORDER).alias(ORDER)))
        return replace(self, frames=tuple(frames))

    def child_order(self, n: Column) -> Column:
        return F.concat(F.col(ORDER), F.array(n.cast("long")))

    def window(self, descending: bool = False) -> Any:
        order = F.col(ORDER).desc() if descending else F.col(ORDER)
        return Window.partitionBy(*self.groups).orderBy(order)

    def starts(self) -> Column:
        """What leads the order key of records that a body makes for a group: the keys of all open groups, outermost first."""
        return F.concat(F.array().cast("array<bigint>"), *[F.col(g) for g in self.groups])

    def ranked(self, name: str, descending: bool = False) -> Stream:
        """Adds the place of each record in its group, from 0. The root group is cut at quantiles of its order key, taken from a
        bounded sample by hash, ranked piece by piece, and shifted by the counts of the pieces before, so no task sees the whole
        stream. The cuts are literals: every evaluation of the plan, in whichever task, cuts alike. The sample is a job that runs
        when the plan is built."""
        if self.groups:
            return replace(self, df=self.df.withColumn(name, (F.row_number().over(self.window(descending)) - 1).cast("long")))
        pieces = min(MOST_PIECES, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        seen = [r[ORDER] for r in self.df.select(ORDER).orderBy(F.xxhash64(ORDER)).limit(SAMPLED * pieces).collect()]
        seen.sort()
        cuts = sorted({tuple(seen[len(seen) * (i + 1) // pieces]) for i in range(pieces - 1)}) if seen else []

        def piece(low: int, high: int) -> Column:
            """The number of cuts before a record, by halving."""
            if low == high:
                return F.lit(low)
            mid = (low + high) // 2
            return F.when(F.array(*[F.lit(x).cast("long") for x in cuts[mid]]) < F.col(ORDER), piece(mid + 1, high)).otherwise(piece(low, mid))

        cut = self.df.withColumn("_p", piece(0, len(cuts)))
        order = Window.orderBy(F.col("_p").desc() if descending else F.col("_p")).rowsBetween(Window.unboundedPreceding, -1)
        before = F.coalesce(F.sum("_n").over(order), F.lit(0))
        starts = cut.groupBy("_p").agg(F.count("*").alias("_n")).withColumn("_before", before).drop("_n")
        own = F.row_number().over(Window.partitionBy("_p").orderBy(F.col(ORDER).desc() if descending else F.col(ORDER)))
        df = cut.withColumn("_k", own).join(F.broadcast(starts), "_p").withColumn(name, (F.col("_before") + F.col("_k") - 1).cast("long"))
        return replace(self, df=df.drop("_p", "_k", "_before"))

    def ordered(self) -> DataFrame:
        return self.df.orderBy(ORDER)


def from_dataframe(df: DataFrame, order_by: list[str] | str, value: str | None = None, atoms: dict | None = None) -> Stream:
    """A stream of the rows of df in the order of integer columns; all columns are named, `value` is the current one."""
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    clash = {c: f"c_{c}" for c in df.columns if c.startswith("_")}
    cols = [F.col(f"`{c}`").alias(clash.get(c, c)) for c in df.columns]
    names = {c: clash.get(c, c) for c in df.columns}
    order = F.array(*[F.col(f"`{k}`").cast("long") for k in keys]).alias(ORDER)
    current = F.col(f"`{value}`") if value else F.lit(None).cast("string")
    return Stream(df.select(order, current.alias(VALUE), F.lit(None).cast("string").alias(ERROR), *cols), names, (), atoms or {}, value is None)


def empty_start(spark: SparkSession) -> Stream:
    """What a pipeline without input starts with: one undefined record."""
    df = spark.range(1).select(F.array(F.lit(0).cast("long")).alias(ORDER), F.lit(None).cast("string").alias(VALUE), F.lit(None).cast("string").alias(ERROR))
    return Stream(df, undefined=True)


def from_values(spark: SparkSession, values: list, kind: str | None = None) -> Stream:
    """A stream of Python values (null values allowed); values of several types keep their kinds, as VARIANT."""
    types = {bool: "boolean", int: "bigint", float: "double", str: "string", bytes: "binary"}
    kinds = {type(v) for v in values if v is not None}
    if kind is None and (len(kinds) > 1 or kinds & {list, dict}):
        rows = spark.createDataFrame([(i, None if v is None else json.dumps(v)) for i, v in enumerate(values)], "_i bigint, _j string")
        df = rows.select("_i", F.parse_json("_j").alias(VALUE))
    else:
        kind = kind or types.get(next(iter(kinds), str), "string")
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"_i bigint, {VALUE} {kind}")
    return Stream(df.select(F.array("_i").alias(ORDER), VALUE, F.lit(None).cast("string").alias(ERROR)))


def union(streams: list[Stream], key: Callable[[int, Stream], Column]) -> Stream:
    """Streams one after another, by the order key that `key` gives. Where current values or named columns differ in type
    they become VARIANT, which keeps the kind of each; a column that a stream lacks is null there."""
    names: dict[str, str] = {}
    for s in streams:
        for n in s.names:
            names.setdefault(n, f"n_{n}")
    frames, groups = streams[0].frames, streams[0].groups
    kinds = {c: {s.type_of(s.names[n]) for s in streams if n in s.names} for n, c in names.items()}
    values = {s.type_of(VALUE) for s in streams if not isinstance(s.type_of(VALUE), T.NullType) and not s.undefined}
    mixed = len(values) > 1
    out = None
    for i, s in enumerate(streams):
        v = F.col(VALUE)
        if mixed:
            v = as_variant(typed_value(v, s.type_of(VALUE))) if not s.undefined else F.lit(None).cast("variant")
        elif values and s.undefined:
            v = F.lit(None).cast(next(iter(values)))
        cols = []
        for n, c in names.items():
            x = F.col(f"`{s.names[n]}`") if n in s.names else F.lit(None)
            if len(kinds[c]) > 1:
                x = as_variant(typed_value(x, s.type_of(s.names[n]))) if n in s.names else x.cast("variant")
            cols.append((x if len(kinds[c]) > 1 else x.cast(next(iter(kinds[c])))).alias(c))
        df = s.df.select(key(i, s).alias(ORDER), *groups, v.alias(VALUE), ERROR, *cols)
        out = df if out is None else out.unionByName(df)
    return Stream(out, names, frames, streams[0].atoms, all(s.undefined for s in streams))
