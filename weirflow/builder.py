"""Pipelines in Python: a fluent builder over the operators."""

from __future__ import annotations

from decimal import Decimal
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import VariantVal

from weirflow import operators as O
from weirflow import sources
from weirflow.functions.expressions import typed_value
from weirflow.functions.formats import show, typed
from weirflow.records import ERROR, ORDER, VALUE, Stream, empty_start, from_dataframe, from_values


class RecordError(Exception):
    """A record's value is an error."""


def _python(v: Any) -> Any:
    """A collected value as plain Python."""
    if isinstance(v, VariantVal):
        return _python(v.toPython())
    if isinstance(v, Decimal) and v == v.to_integral_value():
        return int(v)
    return [_python(x) for x in v] if isinstance(v, list) else v


class Pipeline:
    """A stream and what is done to it; every method gives a new pipeline, and nothing runs before a sink."""

    def __init__(self, spark: SparkSession, stream: Stream | None = None):
        self.spark, self.stream = spark, stream or empty_start(spark)

    def then(self, *ops: O.Op) -> Pipeline:
        return Pipeline(self.spark, O.chain(*ops)(self.stream))

    def __getattr__(self, name: str) -> Any:
        """Any operator by name; `sum`, `max`, `filter`, `format`, `to_int` and `to_float` are spelled so."""
        op = getattr(O, f"{name}_", None) or getattr(O, name, None)
        if op is None or name.startswith("_"):
            raise AttributeError(name)
        return lambda *args, **kw: self.then(op(*args, **kw))

    @classmethod
    def from_dataframe(cls, df: DataFrame, order_by: list[str] | str, value: str | None = None) -> Pipeline:
        return cls(df.sparkSession, from_dataframe(df, order_by, value))

    @classmethod
    def from_values(cls, spark: SparkSession, values: list, kind: str | None = None) -> Pipeline:
        return cls(spark, from_values(spark, values, kind))

    @classmethod
    def csv(cls, spark: SparkSession, path: str, **options: Any) -> Pipeline:
        return cls(spark, sources.csv(spark, path, **options))

    @classmethod
    def jsonl(cls, spark: SparkSession, path: str, **options: Any) -> Pipeline:
        return cls(spark, sources.jsonl(spark, path, **options))

    @classmethod
    def file(cls, spark: SparkSession, path: str, binary: bool = False) -> Pipeline:
        return cls(spark, sources.file(spark, path, binary))

    @classmethod
    def text_lines(cls, spark: SparkSession, path: str) -> Pipeline:
        return cls(spark, sources.text_lines(spark, path))

    @classmethod
    def stdin(cls, spark: SparkSession, text: str | None = None) -> Pipeline:
        return cls(spark, sources.stdin(spark, text))

    def fork(self, *bodies: O.Op) -> list[Pipeline]:
        return [Pipeline(self.spark, b(self.stream)) for b in bodies]

    # Sinks

    def to_dataframe(self, value: str = "value", order: bool = False, error: bool = False, variant: bool = False) -> DataFrame:
        """The named columns, then the current one as `value`; order and error columns if asked for. Columns of mixed kinds are given
        as text, or as VARIANT if asked for."""
        s = self.stream
        shown = lambda c: show(typed_value(F.col(f"`{c}`"), s.type_of(c))) if isinstance(s.type_of(c), T.VariantType) and not variant else F.col(f"`{c}`")
        extra = [F.col(ORDER).alias("order")] * order + [F.col(ERROR).alias("error")] * error
        return s.df.select(*[shown(c).alias(n) for n, c in s.names.items() if n != value], shown(VALUE).alias(value), *extra)

    def _shown(self) -> DataFrame:
        s = self.stream
        v = typed_value(F.col(VALUE), s.type_of(VALUE))
        plain = show(v) if v.kind not in ("array", "object") else typed(v)
        text = F.when(F.col(ERROR).isNotNull(), F.concat(F.lit("ERROR: "), F.col(ERROR))).otherwise(F.coalesce(plain, F.lit("undefined" if s.undefined else "null")))
        return s.df.select(ORDER, text.alias("value"))

    def strings(self) -> list[str]:
        """What printing would show, in order."""
        return [r["value"] for r in self._shown().orderBy(ORDER).collect()]

    def collect(self) -> list:
        """The values in order; the first error value is raised."""
        rows = self.stream.df.select(ORDER, VALUE, ERROR).orderBy(ORDER).collect()
        for r in rows:
            if r[ERROR] is not None:
                raise RecordError(r[ERROR])
        return [_python(r[VALUE]) for r in rows]

    def succeeded(self) -> bool:
        """Whether no value is an error."""
        return self.stream.df.where(F.col(ERROR).isNotNull()).isEmpty()

    def write(self, path: str, ignore_nulls: bool = False) -> None:
        """Shown values as text files, range-partitioned so that files follow the order; null and undefined ones too unless they are
        to be ignored."""
        kept = self._kept(ignore_nulls)
        kept._shown().repartitionByRange(ORDER).sortWithinPartitions(ORDER).select("value").write.text(path)

    def _kept(self, ignore_nulls: bool) -> Pipeline:
        keep = F.col(VALUE).isNotNull() | F.col(ERROR).isNotNull()
        return Pipeline(self.spark, self.stream.where(keep)) if ignore_nulls else self

    def print(self, ignore_nulls: bool = False) -> None:
        """Shown values to standard output, in order, fetched partition by partition."""
        for r in self._kept(ignore_nulls)._shown().orderBy(ORDER).select("value").toLocalIterator():
            print(r["value"])

    def printed(self) -> Pipeline:
        """What is left of the records once they have been printed: null, or the error."""
        s = self.stream
        return Pipeline(self.spark, s.with_value(F.lit(None).cast("string")))
