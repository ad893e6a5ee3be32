"""Operators on record streams: each takes a stream and gives a stream."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirflow.functions.expressions import BIG, Value, array_of, as_variant, compile_expression, dynamic_kind, kind_of, to_float, to_int, type_of, typed_value
from weirflow.functions.formats import compile_format, show
from weirflow.functions.patterns import translate
from weirflow.records import ERROR, ORDER, VALUE, Stream, union

Op = Callable[[Stream], Stream]


def _null() -> Column:
    return F.lit(None).cast("string")


def chain(*ops: Op) -> Op:
    def run(s: Stream) -> Stream:
        for op in ops:
            s = op(s)
        return s

    # A chain is done with its input where one of its operators is, if those before make one record of one.
    run.takes = None
    for op in ops:
        run.takes = getattr(op, "takes", None)
        if run.takes is not None or not getattr(op, "steady", False):
            break
    run.steady = all(getattr(op, "steady", False) for op in ops)
    return run


def _steady(op: Op) -> Op:
    """Marks an operator that makes one record of each."""
    op.steady = True
    return op


def _taking(n: int | None, op: Op) -> Op:
    """Marks an operator that is done with its input after n records."""
    op.takes = n
    return op


# Naming and scope


def key(name: str) -> Op:
    """Name the current column."""
    return _steady(lambda s: replace(s, df=s.df.withColumn(f"n_{name}", F.col(VALUE)), names={**s.names, name: f"n_{name}"}))


def select(name: str) -> Op:
    """Make a named column the current one; an unknown name gives undefined values."""

    def run(s: Stream) -> Stream:
        col = s.names.get(name)
        if col is None:
            return replace(s, df=s.df.withColumns({VALUE: _null(), ERROR: _null()}), undefined=True)
        return s.with_value(F.col(f"`{col}`"), keep_error=False)

    return _steady(run)


def nop() -> Op:
    return _steady(lambda s: s)


def atom(name: str, value: object) -> Op:
    """A constant of the scope, read as {%name}."""
    return lambda s: replace(s, atoms={**s.atoms, name: value})


def define(label: str, *ops: Op) -> Op:
    """Give a chain a label that `call` can name."""
    return atom(f"chain {label}", chain(*ops))


def call(label: str) -> Op:
    """Go on with a labelled chain."""

    def run(s: Stream) -> Stream:
        if f"chain {label}" not in s.atoms:
            raise ValueError(f"no chain is labelled {label!r}")
        return s.atoms[f"chain {label}"](s)

    return run


def transparent(op: Op) -> Op:
    """Run op for the columns it names and the records it keeps; the current column stays what it was."""

    def run(s: Stream) -> Stream:
        got = op(replace(s, df=s.df.withColumns({"_tv": F.col(VALUE), "_te": F.col(ERROR)}), names={**s.names, "\0v": "_tv", "\0e": "_te"}))
        names = {k: v for k, v in got.names.items() if not k.startswith("\0")}
        df = got.df.withColumns({VALUE: F.col(got.names["\0v"]), ERROR: F.col(got.names["\0e"])}).drop("_tv", "_te")
        return replace(got, df=df, names=names, undefined=s.undefined)

    return run


def explode() -> Op:
    """An object's keys become columns; the current value is then null. Other values stay."""

    def run(s: Stream) -> Stream:
        t = s.type_of(VALUE)
        if not isinstance(t, T.StructType):
            return s
        names = {**s.names, **{f.name: f"n_{f.name}" for f in t.fields}}
        df = s.df.withColumns({f"n_{f.name}": F.col(VALUE)[f.name] for f in t.fields})
        return replace(s, df=df.withColumn(VALUE, _null()), names=names)

    return run


def typename() -> Op:
    """The kind of each value; big integers are `int`."""

    def run(s: Stream) -> Stream:
        kind = "undefined" if s.undefined else kind_of(s.type_of(VALUE))
        plain = lambda k: F.when(k == "big", F.lit("int")).otherwise(k)
        named = plain(dynamic_kind(F.col(VALUE))) if kind == "any" else F.lit({"big": "int"}.get(kind, kind))
        v = F.when(F.col(ERROR).isNotNull(), F.lit("error")).when(F.col(VALUE).isNull(), F.lit("undefined" if s.undefined else "null")).otherwise(named)
        return s.with_value(v, keep_error=False)

    return _steady(run)


# Generators


def constant(value: object) -> Value:
    """A Python value as a column: arrays of several kinds keep the kind of each element, objects are structs."""
    if value is None:
        return Value(F.lit(None), "null")
    if isinstance(value, dict):
        if not value:
            return Value(F.create_map().cast("map<string,string>"), "object", t=T.MapType(T.StringType(), T.StringType()))
        inner = {k: constant(v) for k, v in value.items()}
        fields = [T.StructField(k, type_of(v)) for k, v in inner.items()]
        return Value(F.struct(*[inner[f.name].col.cast(f.dataType).alias(f.name) for f in fields]), "object", t=T.StructType(fields))
    if isinstance(value, list | tuple):
        return array_of([constant(v) for v in value])
    if isinstance(value, bytes):
        return Value(F.lit(bytearray(value)), "bytes")
    if isinstance(value, int) and not isinstance(value, bool):
        if abs(value) >= 10**38:
            raise ValueError(f"integer of more than 38 digits: {value}")
        return Value(F.lit(value).cast("long"), "int") if -(1 << 63) <= value < 1 << 63 else Value(F.lit(str(value)).cast(BIG), "big")
    return Value(F.lit(value), {bool: "bool", float: "float"}.get(type(value), "str"))


def literal(value: object, count: int = 1) -> Op:
    """The same value for each record, `count` times each."""

    def run(s: Stream) -> Stream:
        v = constant(value)
        out = s.with_value(v.col if value is not None else _null(), keep_error=False)
        return dup(count)(out) if count != 1 else out

    return _steady(run) if count == 1 else run


def undefined() -> Op:
    return lambda s: replace(s, df=s.df.withColumns({VALUE: _null(), ERROR: _null()}), undefined=True)


def error(message: str) -> Op:
    return lambda s: s.with_value(_null(), F.lit(message), keep_error=False)


def bounds(begin: int, end: int, step: int) -> tuple[int, int]:
    """(first, number) of begin, begin + step, ... before end."""
    if step == 0:
        raise ValueError("sequence step cannot be zero")
    return begin, max(0, -(-(end - begin) // step) if step > 0 else -(-(begin - end) // -step))


def seq(end: int, begin: int = 0, step: int = 1) -> Op:
    """For each record, the integers from begin before end."""

    def run(s: Stream) -> Stream:
        first, n = bounds(begin, end, step)
        if n == 0:
            return s.where(F.lit(False)).with_value(F.lit(0).cast("long"), keep_error=False)
        last = first + (n - 1) * step
        keep = [c for c in s.df.columns if c not in (VALUE, ERROR)]
        df = s.df.select(*keep, F.posexplode(F.sequence(F.lit(first).cast("long"), F.lit(last).cast("long"), F.lit(step).cast("long"))).alias("_i", VALUE))
        df = df.withColumns({ORDER: s.child_order(F.col("_i")), ERROR: _null()}).drop("_i")
        return replace(s, df=df, undefined=False)

    return run


def seqn(end: int, begin: int = 1, step: int = 1) -> Op:
    """Natural counting: from 1, the end included."""
    return seq(end + (1 if step > 0 else -1), begin, step)


def enum(end: int | None = None, begin: int = 0, step: int = 1) -> Op:
    """Number the records of each group; those beyond the numbers go."""

    def run(s: Stream) -> Stream:
        r = s.ranked("_r")
        if end is not None:
            r = r.where(F.col("_r") < bounds(begin, end, step)[1])
        out = r.with_value(F.lit(begin) + F.col("_r") * step, keep_error=False)
        return replace(out, df=out.df.drop("_r"))

    return _steady(run) if end is None else _taking(bounds(begin, end, step)[1], run)


def enumn(end: int | None = None, begin: int = 1, step: int = 1) -> Op:
    return enum(None if end is None else end + (1 if step > 0 else -1), begin, step)


def enum_unbounded(end: int, begin: int = 0, step: int = 1) -> Op:
    """Number the records of each group and go on to `end` with undefined records."""

    def run(s: Stream) -> Stream:
        s = s.remember()
        first, n = bounds(begin, end, step)
        r = s.ranked("_r").df.withColumn("_keep", F.lit(True)).drop(VALUE, ERROR)
        base = s.frames[-1].select(*s.groups) if s.groups else s.spark.range(1).select()
        full = base.select(*s.groups, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(0, n - 1)).cast("long"))).alias("_r")).where(F.lit(n > 0))
        df = full.join(r, [*s.groups, "_r"], "left")
        # What is made up stands after the group's records, in the order of its number.
        top = F.array(F.lit((1 << 62)), F.col("_r"))
        order = F.coalesce(F.col(ORDER), F.concat(F.col(s.groups[-1]) if s.groups else F.array().cast("array<bigint>"), top))
        df = df.withColumns({ORDER: order, VALUE: F.lit(first) + F.col("_r") * step, ERROR: _null()}).drop("_r", "_keep")
        return replace(s, df=df, undefined=False)

    return run


def first_primes(n: int) -> list[int]:
    out: list[int] = []
    limit = 16
    while len(out) < n:
        limit *= 2
        sieve = bytearray([1]) * (limit + 1)
        sieve[:2] = b"\0\0"
        for p in range(2, int(limit**0.5) + 1):
            if sieve[p]:
                sieve[p * p :: p] = bytes(len(range(p * p, limit + 1, p)))
        out = [i for i, x in enumerate(sieve) if x]
    return out[:n]


def primes(count: int) -> Op:
    """For each record, the first `count` primes; a pipeline bounds them by the head that follows."""

    def run(s: Stream) -> Stream:
        keep = [c for c in s.df.columns if c not in (VALUE, ERROR)]
        df = s.df.select(*keep, F.posexplode(F.array(*[F.lit(p).cast("long") for p in first_primes(count)])).alias("_i", VALUE))
        return replace(s, df=df.withColumns({ORDER: s.child_order(F.col("_i")), ERROR: _null()}).drop("_i"), undefined=False)

    return run


# Records kept and repeated


def filter_() -> Op:
    """Keep what isn't false, null or undefined; errors stay."""

    def run(s: Stream) -> Stream:
        ok = F.col(VALUE).isNotNull()
        if isinstance(s.type_of(VALUE), T.BooleanType):
            ok = ok & F.col(VALUE)
        elif isinstance(s.type_of(VALUE), T.VariantType):
            ok = ok & ~F.is_variant_null(VALUE) & F.coalesce(F.try_variant_get(VALUE, "$", "boolean"), F.lit(True))
        return s.where(ok | F.col(ERROR).isNotNull())

    return run


def drop() -> Op:
    return lambda s: s.where(F.lit(False))


def dup(n: int = 2) -> Op:
    """Each record n times, side by side."""

    def run(s: Stream) -> Stream:
        if n == 0:
            return drop()(s)
        df = s.df.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        return replace(s, df=df.withColumn(ORDER, s.child_order(F.col("_i"))).drop("_i"))

    return run


def eliminate_errors() -> Op:
    return lambda s: s.where(F.col(ERROR).isNull())


def head(n: int = 1) -> Op:
    """The first n records of each group; all but the last -n if n is negative."""

    def run(s: Stream) -> Stream:
        if n >= 0 and not s.groups:
            return replace(s, df=s.df.orderBy(ORDER).limit(n))
        r = s.remember().ranked("_r", descending=n < 0)
        r = r.where(F.col("_r") < n if n >= 0 else F.col("_r") >= -n)
        return replace(r, df=r.df.drop("_r"))

    return _taking(n if n >= 0 else None, run)


def tail(n: int = 1) -> Op:
    def run(s: Stream) -> Stream:
        if not s.groups:
            return replace(s, df=s.df.orderBy(F.col(ORDER).desc()).limit(n))
        r = s.remember().ranked("_r", descending=True).where(F.col("_r") < n)
        return replace(r, df=r.df.drop("_r"))

    return run


def skip(n: int) -> Op:
    """All records of each group but the first n."""

    def run(s: Stream) -> Stream:
        r = s.remember().ranked("_r").where(F.col("_r") >= n)
        return replace(r, df=r.df.drop("_r"))

    return run


def flatten() -> Op:
    """An array's elements, or an object's [key, value] pairs, one a record; an empty one gives none; other values stay."""

    def pairs(entries: Column, v: T.DataType, key: Callable, val: Callable) -> Column:
        if isinstance(v, T.StringType):
            return F.transform(entries, lambda e: F.array(key(e), val(e)))
        return F.transform(entries, lambda e: F.array(key(e).cast("variant"), as_variant(typed_value(val(e), v))))

    def run(s: Stream) -> Stream:
        t = s.type_of(VALUE)
        if isinstance(t, T.StructType):
            texts = all(isinstance(f.dataType, T.StringType) for f in t.fields)
            cell = lambda f: F.col(VALUE)[f.name] if texts else as_variant(typed_value(F.col(VALUE)[f.name], f.dataType))
            arr = F.when(F.col(VALUE).isNotNull(), F.array(*[F.array(F.lit(f.name) if texts else F.lit(f.name).cast("variant"), cell(f)) for f in t.fields]))
        elif isinstance(t, T.MapType):
            arr = pairs(F.map_entries(VALUE), t.valueType, lambda e: e["key"].cast("string"), lambda e: e["value"])
        elif isinstance(t, T.ArrayType):
            arr = F.col(VALUE)
        elif isinstance(t, T.VariantType):
            entries = F.map_entries(F.try_variant_get(VALUE, "$", "map<string,variant>"))
            two = F.transform(entries, lambda e: F.call_function("to_variant_object", F.array(e["key"].cast("variant"), e["value"])))
            kind = dynamic_kind(F.col(VALUE))
            arr = F.when(kind == "array", F.try_variant_get(VALUE, "$", "array<variant>")).when(kind == "object", two).otherwise(F.array(VALUE))
        else:
            return s
        s = s.remember()
        # A value that is null or an error is no array: it stays.
        arr = F.when(F.col(VALUE).isNull(), F.array(F.lit(None))).otherwise(arr)
        keep = [c for c in s.df.columns if c != VALUE]
        df = s.df.select(*keep, F.posexplode(arr).alias("_i", VALUE))
        return replace(s, df=df.withColumn(ORDER, s.child_order(F.col("_i"))).drop("_i"))

    return run


# Groups, fan-out and fan-in


def foreach(*ops: Op) -> Op:
    """Each record is a group of its own for the body."""

    def run(s: Stream) -> Stream:
        g = f"_g{s.level + 1}"
        inner = replace(s, df=s.df.withColumn(g, F.col(ORDER)), frames=(*s.frames, None))
        return _leave(chain(*ops)(inner), s)

    return run


def _leave(inner: Stream, outer: Stream) -> Stream:
    return replace(inner, df=inner.df.drop(f"_g{outer.level + 1}"), frames=inner.frames[: outer.level], atoms=outer.atoms)


def chunks(n: int, *ops: Op) -> Op:
    """Groups of n records within each group for the body; the last may be smaller."""
    if n <= 0:
        raise ValueError("chunk size must be positive")

    def run(s: Stream) -> Stream:
        g = f"_g{s.level + 1}"
        r = s.ranked("_r")
        df = r.df.withColumn(g, F.array(F.floor(F.col("_r") / n).cast("long"))).drop("_r")
        return _leave(chain(*ops)(replace(r, df=df, frames=(*s.frames, None))), s)

    return run


def fork(*bodies: Op) -> Callable[[Stream], list[Stream]]:
    """One result for each body, all from the same stream."""
    return lambda s: [b(s) for b in bodies]


def _in_turn(s: Stream, got: list[Stream]) -> Stream:
    """Streams made of s, one after another in each group: records stand by group, then by body, then by their own order."""
    return union(got, lambda i, x: F.concat(s.starts(), F.array(F.lit(i).cast("long")), F.col(ORDER)))


def forkcat(*bodies: Op) -> Op:
    """The stream through each body, outputs one after another in each group."""
    return lambda s: _in_turn(s, [b(s) for b in bodies])


def aggregate(*bodies: Op) -> Op:
    """Each body gets the records until it is done with its input (head and a bounded enum are), the next one those that are left;
    where none are left it gets the group's last record again. Outputs one after another in each group."""

    def run(s: Stream) -> Stream:
        takes = [getattr(b, "takes", None) for b in bodies[:-1]] + [None]
        if takes[0] is None:
            last = tail(1)(s)
            return _in_turn(s, [b(s if i == 0 else last) for i, b in enumerate(bodies)])
        s = s.remember()
        r = replace(s, df=s.ranked("_r").df)
        r = replace(r, df=r.ranked("_d", descending=True).df)
        got, begin = [], 0
        for b, n in zip(bodies, takes, strict=True):
            at = F.col("_r")
            mine = ((at < begin) & (F.col("_d") == 0)) if begin is not None else F.col("_d") == 0
            if begin is not None:
                mine = mine | ((at >= begin) & ((at < begin + n) if n is not None else F.lit(True)))
            got.append(b(replace(r, df=r.df.where(mine).drop("_r", "_d"))))
            begin = None if begin is None or n is None else begin + n
        return _in_turn(s, got)

    return run


# Text


def regex(pattern: str, *, ignore_case: bool = False, multi: bool = False, overlapping: bool = False, optional: bool = False, full: bool = False, invert: bool = False, lines: bool = False, dot_all: bool = False, ascii_only: bool = False) -> Op:
    """Match each value. The output is the match, or the group named by nothing, or the whole input if full; each group is a
    column; records that don't match go, unless optional. multi: one record a match; overlapping: a match may start one
    character after the one before it; invert: keep what doesn't match."""
    if invert and (multi or overlapping):
        raise ValueError("an inverted match has no matches to repeat")
    p = translate(pattern, ignore_case, lines, dot_all, ascii_only)
    if full and "" in p.groups:
        raise ValueError("a full match cannot have an output group")

    def run(s: Stream) -> Stream:
        text = show(typed_value(F.col(VALUE), s.type_of(VALUE))) if not s.undefined else F.lit(None).cast("string")
        error = F.col(ERROR).isNotNull()
        if invert:
            return s.where(error | ~F.coalesce(text.rlike(p.java), F.lit(False)))
        out_group = p.groups.index("") + 1 if "" in p.groups else 0
        shown = {name: i + 1 for i, name in enumerate(p.groups) if name}

        def unmatched(c: Column, *marks: Column) -> Column:
            """c, or null where the group's marks say that it has had no part in the match."""
            return F.when((c != "") | (marks[0] != "") | (marks[1] != ""), c) if marks else c

        def beside(i: int) -> tuple[int, ...]:
            return (i, *(p.marks[i - 1] if p.marks else ()))

        names = {**s.names, **{n: f"n_{n}" for n in shown}}
        if not (multi or overlapping):
            hit = F.coalesce(text.rlike(p.java), F.lit(False))
            got = {f"n_{n}": F.when(hit, unmatched(*[F.regexp_extract(text, p.java, k) for k in beside(i)])) for n, i in shown.items()}
            value = F.when(hit, F.col(VALUE).cast("string") if full else F.regexp_extract(text, p.java, out_group))
            if not optional:
                s = s.where(hit | error)
            out = replace(s, df=s.df.withColumns({"_x": value, **got}))
            out = out.with_value(F.col("_x"))
            return replace(out, df=out.df.drop("_x"), names=names)
        # Overlapping matches are what look-ahead captures at each place.
        java, shift = (p.java[: p.java.index(")") + 1] + "(?=(" + p.java[p.java.index(")") + 1 :] + "))", 1) if overlapping else (p.java, 0)
        cols = {"_x": F.regexp_extract_all(text, F.lit(java), F.lit(out_group + shift))}
        cols |= {f"_m{k}_{n}": F.regexp_extract_all(text, F.lit(java), F.lit(k + shift)) for n, i in shown.items() for k in beside(i)}
        s = s.remember()
        df = s.df.withColumns({c: F.when(error, F.array(_null())).otherwise(x) for c, x in cols.items()})
        zipped = F.arrays_zip(*cols)
        make = F.posexplode_outer if optional else F.posexplode
        df = df.select(*s.df.columns, F.col(VALUE).alias("_was"), make(zipped).alias("_i", "_z"))
        df = df.withColumns({VALUE: F.col("_was").cast("string") if full else F.col("_z")["_x"], ORDER: s.child_order(F.coalesce("_i", F.lit(0))), **{f"n_{n}": unmatched(*[F.col("_z")[f"_m{k}_{n}"] for k in beside(i)]) for n, i in shown.items()}})
        return replace(s, df=df.drop("_i", "_z", "_was"), names=names, undefined=False)

    return run


def lines() -> Op:
    """One record a line; one line feed at the end is no line."""

    def run(s: Stream) -> Stream:
        s = s.where(F.col(VALUE).isNotNull() | F.col(ERROR).isNotNull())
        text = F.regexp_replace(show(s.lookup("_")) if not s.undefined else _null(), r"\n\z", "")
        return flatten()(s.with_value(F.split(text, "\n", -1)))

    return run


def chars() -> Op:
    return regex(r".", multi=True, dot_all=True)


def trim() -> Op:
    return regex(r"^\s*(?<>.*?)\s*$", dot_all=True)


def format_(text: str) -> Op:
    def run(s: Stream) -> Stream:
        v, err = compile_format(text, s.lookup, s.atoms)
        return s.with_value(v, err, keep_error="?" not in text)

    return _steady(run)


def compute(text: str) -> Op:
    def run(s: Stream) -> Stream:
        v = compile_expression(text, s.lookup)
        value = v.col if v.kind != "null" else _null()
        return s.with_value(F.when(v.err.isNull(), value) if v.err is not None else value, v.err)

    return _steady(run)


def to_int_() -> Op:
    def run(s: Stream) -> Stream:
        v = to_int(s.lookup("_"))
        return s.with_value(v.col, v.err, keep_error=False)

    return _steady(run)


def to_float_() -> Op:
    def run(s: Stream) -> Stream:
        v = to_float(s.lookup("_"))
        return s.with_value(v.col, v.err, keep_error=False)

    return _steady(run)


def to_str() -> Op:
    return _steady(lambda s: s.with_value(show(s.lookup("_")) if not s.undefined else _null()))


def to_literal() -> Op:
    """Each value in literal notation."""
    return format_("{:?}")


def from_literal(schema: str = "string") -> Op:
    """Parse literals as values of a type; text that is none, or of another type, is an error."""

    def run(s: Stream) -> Stream:
        @F.udf(f"struct<v: {schema}, e: string>", useArrow=True)
        def parsed(text: str | None):  # noqa: ANN202
            from weirflow.functions.literals import LiteralError, parse

            try:
                v = None if text is None else parse(text)
                return (str(v) if schema == "string" and v is not None and not isinstance(v, str) else v, None)
            except LiteralError as e:
                return (None, str(e))

        s = replace(s, df=s.df.withColumn("_x", parsed(F.col(VALUE).cast("string"))))
        out = s.with_value(F.col("_x")["v"], F.col("_x")["e"])
        return replace(out, df=out.df.drop("_x"))

    return run


# Folds


def _fold(s: Stream, value: Column, empty: Column | None, errors: bool = True, fails: Column | None = None) -> Stream:
    """One record a group: the first one's columns beside the folded value, or the first error; fails: an error of the fold itself.
    Groups left empty are there with `empty`, or not if None."""
    s = s.remember() if s.groups else s
    named = sorted(set(s.names.values()))
    firsts = [F.min_by(F.col(f"`{c}`"), F.col(ORDER)).alias(c) for c in named]
    err = F.min_by(ERROR, F.when(F.col(ERROR).isNotNull(), F.col(ORDER))) if errors else _null()
    err = F.coalesce(err, fails) if fails is not None else err
    got = s.df.groupBy(*s.groups).agg(F.min(ORDER).alias(ORDER), value.alias(VALUE), err.alias(ERROR), F.count("*").alias("_in"), *firsts)
    if s.groups:
        full = s.frames[-1].select(*s.groups, F.col(ORDER).alias("_fo")).join(got, s.groups, "left" if empty is not None else "inner")
        got = full.withColumn(ORDER, F.coalesce(ORDER, "_fo")).drop("_fo")
    else:
        got = got.withColumn(ORDER, F.coalesce(ORDER, F.array(F.lit(0).cast("long"))))
        got = got if empty is not None else got.where("_in > 0")
    if empty is not None:
        got = got.withColumn(VALUE, F.when(F.coalesce("_in", F.lit(0)) == 0, empty).otherwise(F.col(VALUE)))
    return replace(s, df=got.withColumn(VALUE, F.when(F.col(ERROR).isNull(), F.col(VALUE))).drop("_in"), undefined=False)


def count() -> Op:
    return lambda s: _fold(s, F.count("*"), F.lit(0).cast("long"), errors=False)


def _numbers(s: Stream, what: str) -> tuple[Stream, str]:
    """The stream with an error in place of each value that is no number, and the kind of the others."""
    kind = "undefined" if s.undefined else kind_of(s.type_of(VALUE))
    if kind == "any":
        kinds = dynamic_kind(F.col(VALUE))
        return s.with_value(F.col(VALUE), F.when(~kinds.isin("int", "big", "float"), F.concat(F.lit(f"cannot {what} over type '"), kinds, F.lit("'")))), kind
    if kind not in ("int", "big", "float"):
        s = s.with_value(F.lit(0).cast("long"), F.lit(f"cannot {what} over type '{kind}'"))
        kind = "int"
    return s, kind


#: Doubles that 12 decimal places hold exactly, up to this size, are summed as decimals; others by parts of their bits.
_PLAIN, _STEP = 1e12, 32


def _doubles(s: Stream, v: Column, whole_numbers: Column | None = None) -> tuple[Stream, Column, Column]:
    """(records of partial sums, double total, number of values) of doubles v (nulls don't count), exact before one rounding of each
    part at the end, so that the order doesn't matter. whole_numbers are summed beside them in `_ints`.

    A value that 12 decimal places hold goes into a decimal sum. Any other is m * 2^u with whole m; values whose u falls into the
    same step of 32 share a sum of whole numbers, which aggregates like any sum. Infinities and NaN are counted beside them."""
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    near = F.when(finite & (F.abs(v) < _PLAIN), v).cast("decimal(38,12)")
    plain = F.coalesce((near.cast("double") == v), F.lit(False))
    e = F.floor(F.log2(F.when(finite & ~plain, F.abs(v)))).cast("int")
    up = F.lit(54) - e  # v * 2^up is whole and below 2^56
    m = (v * F.pow(F.lit(2.0), F.floor(up / 2)) * F.pow(F.lit(2.0), up - F.floor(up / 2))).cast("long")
    step = F.floor((e - 54) / _STEP).cast("int")
    whole = m.cast("decimal(20,0)") * F.pow(F.lit(2.0), (e - 54) - step * _STEP).cast("long").cast("decimal(11,0)")
    named = sorted(set(s.names.values()))
    s = s.remember() if s.groups else s
    df = s.df.withColumns({"_step": step, "_near": F.when(plain, near), "_whole": whole.cast(BIG), "_x": v, "_ints": F.lit(None).cast(BIG) if whole_numbers is None else whole_numbers})
    flags = {"_nan": F.isnan("_x"), "_up": F.col("_x") == float("inf"), "_down": F.col("_x") == float("-inf"), "_all": F.col("_x").isNotNull()}
    part = df.groupBy(*s.groups, "_step").agg(
        F.min(ORDER).alias(ORDER), F.min_by(ERROR, F.when(F.col(ERROR).isNotNull(), F.col(ORDER))).alias(ERROR), F.try_sum("_near").alias("_near"), F.try_sum("_whole").alias("_whole"), F.try_sum("_ints").alias("_ints"),
        *[F.count(F.when(c, F.lit(1))).alias(n) for n, c in flags.items()], *[F.min_by(F.col(f"`{c}`"), F.col(ORDER)).alias(c) for c in named],
    )
    parts = F.sort_array(F.collect_list(F.struct(F.col("_step").alias("s"), F.col("_whole").alias("m"))), asc=False)
    half = lambda p: F.pow(F.lit(2.0), p["s"] * (_STEP // 2))
    rest = F.aggregate(parts, F.lit(0.0), lambda a, p: a + F.when(p["s"].isNull(), F.lit(0.0)).otherwise(p["m"].cast("double") * half(p) * half(p)))
    total = F.coalesce(F.sum("_near").cast("double"), F.lit(0.0)) + F.coalesce(rest, F.lit(0.0))
    nan = (F.sum("_nan") > 0) | (F.sum("_up") > 0) & (F.sum("_down") > 0)
    total = F.when(nan, F.lit(float("nan"))).when(F.sum("_up") > 0, F.lit(float("inf"))).when(F.sum("_down") > 0, F.lit(float("-inf"))).otherwise(total)
    return replace(s, df=part.withColumn(VALUE, F.lit(None).cast("double"))), total, F.sum("_all")


def _whole_sum(v: Column) -> tuple[Column, Column]:
    """(sum of whole numbers in 38 digits, error where they don't suffice)."""
    total = F.try_sum(v.cast(BIG))
    return total, F.when(total.isNull() & (F.count(v) > 0), F.lit("integer of more than 38 digits"))


def sum_(exact: bool = True) -> Op:
    """Integers sum in 38 digits, an error beyond; doubles exactly (rounded once) if exact, else as doubles add up."""

    def run(s: Stream) -> Stream:
        s, kind = _numbers(s, "sum")
        if kind in ("int", "big"):
            total, fails = _whole_sum(F.col(VALUE))
            return _fold(s, F.coalesce(total, F.lit(0).cast(BIG)), F.lit(0).cast(BIG), fails=fails)
        if kind == "float":
            if not exact:
                return _fold(s, F.sum(F.col(VALUE).cast("double")), F.lit(0.0))
            parts, total, _ = _doubles(s, F.col(VALUE).cast("double"))
            return _fold(parts, total, F.lit(0.0))
        kinds = dynamic_kind(F.col(VALUE))
        ints = F.when(kinds.isin("int", "big"), F.try_variant_get(VALUE, "$", BIG))
        parts, total, n = _doubles(s, F.when(kinds == "float", F.try_variant_get(VALUE, "$", "double")), ints)
        whole = F.coalesce(F.try_sum("_ints"), F.lit(0).cast(BIG))
        return _fold(parts, F.when(n == 0, whole.cast("variant")).otherwise((whole.cast("double") + total).cast("variant")), F.lit(0).cast("long").cast("variant"))

    return run


def avg() -> Op:
    """The mean: the exact total over the number of values, rounded once to a double; of whole numbers past 2^53 the whole part first."""

    def run(s: Stream) -> Stream:
        s, kind = _numbers(s, "average")
        if kind == "any":
            s = s.with_value(F.try_variant_get(VALUE, "$", "double"))
            kind = "float"
        if kind == "float":
            parts, total, n = _doubles(s, F.col(VALUE).cast("double"))
            return _fold(parts, F.try_divide(total, n.cast("double")), F.lit(0.0))
        total, fails = _whole_sum(F.col(VALUE))
        n = F.count(VALUE)
        rest = F.try_mod(total, n.cast(BIG)).cast(BIG)
        mean = F.try_divide((total - rest).cast(BIG), n.cast("decimal(20,0)")).cast("double") + rest.cast("double") / F.when(n > 0, n).cast("double")
        return _fold(s, mean, F.lit(0.0), fails=fails)

    return run


def max_() -> Op:
    """The record with the largest value, the first of equals; an empty group gives none. NaN counts only if all are."""

    def run(s: Stream) -> Stream:
        kind = "undefined" if s.undefined else kind_of(s.type_of(VALUE))
        cols = [c for c in s.df.columns if c not in s.groups]
        v, kinds = F.col(VALUE), dynamic_kind(F.col(VALUE)) if kind == "any" else F.lit(kind)
        bad = ~kinds.isin("int", "big", "float", "bool")
        msg = F.when(bad, F.concat(F.lit("cannot take the maximum over type '"), kinds, F.lit("'")))
        s = s.with_value(v, msg)
        # Whole numbers of a mixed column go by their double, then by their own digits.
        by = F.coalesce(F.try_variant_get(VALUE, "$", "double"), F.try_variant_get(VALUE, "$", "boolean").cast("int").cast("double")) if kind == "any" else v
        digits = F.when(kinds.isin("int", "big"), F.try_variant_get(VALUE, "$", BIG)) if kind == "any" else F.lit(0)
        real = F.when(F.isnan(by), F.lit(0)).otherwise(F.lit(1)) if kind in ("float", "any") else F.lit(1)
        failed = F.col(ERROR).isNotNull()
        rank = F.struct(failed, F.when(~failed, by.isNotNull()), F.when(~failed, real), F.when(~failed, by if kind not in ("array", "object") else F.lit(0)), F.when(~failed, digits), F.transform(ORDER, lambda x: -x))
        best = F.max_by(F.struct(*[F.col(f"`{c}`") for c in cols]), rank)
        got = s.df.groupBy(*s.groups).agg(best.alias("_b")).where("_b is not null").select(*s.groups, "_b.*")
        s = s.remember()
        return replace(s, df=got)

    return run


def _gathered(value: Column) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(ORDER).alias("o"), value.alias("v")))), lambda x: x["v"])


def collect() -> Op:
    """The values of each group as an array, in order."""
    return lambda s: _fold(s, _gathered(F.col(VALUE)), F.array().cast(T.ArrayType(s.type_of(VALUE))))


def join(separator: str = "", count: int | None = None, drop_incomplete: bool = False) -> Op:
    """The values of each group as text, in order; with a count one record for each so many values, the last of fewer unless those
    are dropped. Null and undefined values are errors."""
    if drop_incomplete and count is None:
        raise ValueError("incomplete joins can be dropped only where a count is given")
    if count is not None and count < 1:
        raise ValueError("a join takes at least one value")

    def whole(s: Stream) -> Stream:
        what = "undefined" if s.undefined else "null"
        s = s.with_value(show(s.lookup("_")) if not s.undefined else _null(), F.when(F.col(VALUE).isNull() & F.col(ERROR).isNull(), F.lit(f"type error in join: cannot join '{what}'")))
        return _fold(s, F.array_join(_gathered(F.coalesce(VALUE, F.lit(""))), separator), F.lit(""))

    def run(s: Stream) -> Stream:
        if count is None:
            return whole(s)
        g = f"_g{s.level + 1}"
        s = s.remember()
        r = s.ranked("_r")
        df = r.df.withColumn(g, F.array(F.floor(F.col("_r") / count).cast("long"))).drop("_r")
        inner = replace(r, df=df, frames=(*s.frames, None))
        if drop_incomplete:
            sizes = df.groupBy(*inner.groups).agg(F.count("*").alias("_n")).where(F.col("_n") == count).drop("_n")
            inner = replace(inner, df=df.join(sizes, inner.groups, "left_semi"))
        return _leave(whole(inner), s)

    return run


def xpath(path: str) -> Op:
    """What a path finds in each value as static HTML, one record each; values in which it finds nothing go."""
    from weirflow.functions.html import find

    find(None, path)

    def run(s: Stream) -> Stream:
        found = F.udf(lambda html: find(html, path), "array<string>", useArrow=True)
        kept = s.where(F.col(VALUE).isNotNull() | F.col(ERROR).isNotNull())
        return flatten()(kept.with_value(found(F.col(VALUE).cast("string"))))

    return run


def py(code: str, returns: str = "string") -> Op:
    """Python for each record: statements, then an expression whose value is the result. Free names are columns, `_` is the
    current one. A value of another type than `returns`, or an exception, is an error value. Columns travel in Arrow batches."""
    import ast
    import builtins

    tree = ast.parse(code)
    if not tree.body or not isinstance(tree.body[-1], ast.Expr):
        raise ValueError("python code must end in an expression")
    bound = {n.id for n in ast.walk(tree) if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store)}
    free = sorted({n.id for n in ast.walk(tree) if isinstance(n, ast.Name)} - bound - set(dir(builtins)))
    body = ast.unparse(ast.Module(tree.body[:-1], []))
    last = ast.unparse(tree.body[-1])

    def run(s: Stream) -> Stream:
        use = [n for n in free if n == "_" or n in s.names]

        compiled: list = []  # in each worker, once: code objects don't travel

        @F.udf(f"struct<v: {returns}, e: string>", useArrow=True)
        def call(*args):  # noqa: ANN002, ANN202
            if not compiled:
                compiled.extend((compile(body, "py", "exec") if body else None, compile(last, "py", "eval")))
            scope = dict(zip(use, args, strict=True))
            try:
                if compiled[0] is not None:
                    exec(compiled[0], scope)  # noqa: S102 - running the user's code is what this operator is for
                return (eval(compiled[1], scope), None)  # noqa: S307
            except Exception as e:  # noqa: BLE001
                return (None, f"{type(e).__name__}: {e}")

        args = [F.col(VALUE) if n == "_" else F.col(f"`{s.names[n]}`") for n in use]
        s = replace(s, df=s.df.withColumn("_x", call(*(args or [F.lit(None).cast("string")]))) if use else s.df.withColumn("_x", call()))
        out = s.with_value(F.col("_x")["v"], F.col("_x")["e"])
        return replace(out, df=out.df.drop("_x"))

    return run
