"""Stateless chains on unbounded input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.operators import Op, chain
from weirflow.records import ERROR, ORDER, VALUE, Stream


def on_stream(df: DataFrame, order_by: str, value: str, *ops: Op) -> DataFrame:
    """Operators that look at one record at a time (regex, format, compute, filter, lines, ...) on a streaming DataFrame. Gives the
    order key, the value and the error; folds and positional operators need a bounded stream and fail when the query starts."""
    names = {c: c for c in df.columns if not c.startswith("_")}
    start = df.select(F.array(F.col(order_by).cast("long")).alias(ORDER), F.col(value).alias(VALUE), F.lit(None).cast("string").alias(ERROR), *names)
    out = chain(*ops)(Stream(start, names))
    return out.df.select(F.col(ORDER).alias("order"), F.col(VALUE).alias("value"), F.col(ERROR).alias("error"))
