"""Powers of ten in format strings: results against plain Python, and code that the JVM compiles."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from weirflow.functions.expressions import typed_value
from weirflow.functions.formats import compile_format
from weirflow.plans import catalogue

#: The JVM leaves methods of more bytes of code to its interpreter.
COMPILED = 8000


def shown(spark, sql_type, values, fmt):
    df = spark.createDataFrame(list(enumerate(values)), f"i int, v {sql_type}")
    text, _ = compile_format(fmt, lambda _: typed_value(F.col("v"), df.schema["v"].dataType), {})
    return [r["t"] for r in df.select("i", text.alias("t")).orderBy("i").collect()]


def want(v, e):
    sign, digits, power = Decimal(repr(v) if isinstance(v, float) else v).as_tuple()
    if not any(digits):
        return f"0{e}0"
    kept = "".join(map(str, digits)).rstrip("0")
    return f"{'-' * sign}{kept[0]}{'.' * (len(kept) > 1)}{kept[1:]}{e}{len(digits) - 1 + power}"


WHOLE = [0, 7, -7, 10, -10, 100, 101, 1020, -120300, 9007199254740993, 2**63 - 1, -(2**63)]
FRACTIONS = [0.0, -0.0, 1.0, -1.0, 0.1, 0.01, 0.001, 9.99e-4, 0.00123, 0.5, 12.5, -100.25, 1234567.0, 9999999.5, 1e7, 1.5e10, -2.25e-9, 1e22, 1.7976931348623157e308]


@pytest.mark.parametrize("e", ["e", "E"])
def test_scientific(spark, e):
    fmt = f"{{v:{e}}}"
    assert shown(spark, "bigint", WHOLE, fmt) == [want(v, e) for v in WHOLE]
    assert shown(spark, "decimal(38,0)", [Decimal(v * 10**15) for v in WHOLE], fmt) == [want(v * 10**15, e) for v in WHOLE]
    assert shown(spark, "double", FRACTIONS, fmt) == [want(v, e) for v in FRACTIONS]
    assert shown(spark, "double", [float("nan"), float("inf"), float("-inf"), None], fmt) == ["nan", "inf", "-inf", None]


def code_sizes(df):
    """Bytes of the largest method of each generated stage."""
    debug = getattr(df.sparkSession._jvm.org.apache.spark.sql.execution.debug, "package$").__getattr__("MODULE$")
    stages = debug.codegenStringSeq(df._jdf.queryExecution().executedPlan())
    return [stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())]


def test_scientific_is_compiled(spark, sf):
    """It took 213 microseconds of CPU time a row when the method had 16,711 bytes."""
    sizes = code_sizes(catalogue.queries()["format_scientific"](spark, sf))
    assert sizes and max(sizes) <= COMPILED


@pytest.mark.parametrize("sql_type", ["double", "string", "variant"])
def test_scientific_names_its_text_a_few_times(spark, sql_type):
    """All other kinds: a plan that repeats nothing long (a VARIANT's plain text has three replacements of its own)."""
    df = spark.range(1).select(F.col("id").cast(sql_type).alias("v"))
    text, _ = compile_format("{v:e}", lambda _: typed_value(F.col("v"), df.schema["v"].dataType), {})
    plan = df.select(text.alias("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_") <= 3 + 3 * (sql_type == "variant")
