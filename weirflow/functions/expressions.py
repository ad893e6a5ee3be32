"""The expression language: text to a Column and, where a value can be in error, its error Column."""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TOKEN = re.compile(r"""\s*(?:(?P<float>\d[\d_]*\.\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?|\d[\d_]*[eE][+-]?\d+)|(?P<int>\d[\d_]*)|(?P<str>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<name>[A-Za-z_][A-Za-z0-9_]*)|(?P<op>\*\*|<<|>>|&&|\|\||\^\^|==|!=|<=|>=|[-+*/%&|^<>!~=()\[\]{},.:;]))""", re.S)
#: Binding strength, tightest last.
_LEVELS = {"||": 3, "^^": 4, "&&": 5, "==": 6, "!=": 6, "<": 6, ">": 6, "<=": 6, ">=": 6, "|": 7, "^": 8, "&": 9, "<<": 10, ">>": 10, "+": 11, "-": 11, "*": 12, "/": 12, "%": 12, "**": 13}
_UNARY = 14


@dataclass
class Value:
    """A column, what kind it is (int, big, float, bool, str, bytes, array, object, null, any) and its error message or None. `any`
    is a VARIANT column, whose kind each value tells; t is the column's type where it is known, bits bounds an int, and number is a
    whole literal."""

    col: Column
    kind: str
    err: Column | None = None
    t: T.DataType | None = None
    bits: int = 63
    number: int | None = None


NUMBERS = {"int", "big", "float"}
BIG = "decimal(38,0)"


def kind_of(t: T.DataType) -> str:
    if isinstance(t, T.LongType | T.IntegerType | T.ShortType | T.ByteType):
        return "int"
    if isinstance(t, T.DecimalType):
        return "big" if t.scale == 0 else "float"
    if isinstance(t, T.DoubleType | T.FloatType):
        return "float"
    for k, name in ((T.BooleanType, "bool"), (T.StringType, "str"), (T.BinaryType, "bytes"), (T.ArrayType, "array"), (T.StructType, "object"), (T.MapType, "object"), (T.NullType, "null")):
        if isinstance(t, k):
            return name
    return "any"


def typed_value(col: Column, t: T.DataType, err: Column | None = None) -> Value:
    """The value of a column of a known type."""
    return Value(col, kind_of(t), err, t, {T.IntegerType: 31, T.ShortType: 15, T.ByteType: 7}.get(type(t), 63))


#: The type of a column that an expression makes, by kind.
_TYPES = {"int": T.LongType(), "big": T.DecimalType(38, 0), "float": T.DoubleType(), "bool": T.BooleanType(), "str": T.StringType(), "bytes": T.BinaryType(), "null": T.StringType(), "any": T.VariantType()}


def type_of(v: Value) -> T.DataType:
    return v.t or _TYPES.get(v.kind, T.VariantType())


def dynamic_kind(v: Column) -> Column:
    """The kind of each value of a VARIANT column."""
    s = F.schema_of_variant(v)
    whole = s.isin("BIGINT", "INT", "SMALLINT", "TINYINT")
    named = F.when(whole, F.lit("int")).when(s.rlike(r"^DECIMAL\(\d+,0\)$"), F.lit("big")).when(s.rlike("^(DECIMAL|DOUBLE|FLOAT)"), F.lit("float"))
    named = named.when(s == "STRING", F.lit("str")).when(s == "BOOLEAN", F.lit("bool")).when(s.startswith("ARRAY"), F.lit("array")).when(s.startswith("OBJECT"), F.lit("object")).when(s == "BINARY", F.lit("bytes"))
    return F.when(v.isNull() | (s == "VOID"), F.lit("null")).otherwise(named.otherwise(F.lit("any")))


def as_variant(v: Value) -> Column:
    """The value as a VARIANT that keeps its kind."""
    if v.kind == "any":
        return v.col
    if v.kind == "null":
        return F.lit(None).cast("variant")
    if v.kind == "float":
        return v.col.cast("double").cast("variant")
    if v.kind in ("array", "object"):
        return F.call_function("to_variant_object", v.col)
    return v.col.cast("variant")


def _branches(x: Value) -> list[tuple[Column | None, Value]]:
    if x.kind != "any":
        return [(None, x)]
    kind = dynamic_kind(x.col)
    out = [(kind == k, Value(F.try_variant_get(x.col, "$", t), k, x.err)) for k, t in (("int", "bigint"), ("big", BIG), ("float", "double"), ("str", "string"), ("bool", "boolean"))]
    return [*out, (kind == "array", Value(F.lit(None), "array", x.err)), (kind == "object", Value(F.lit(None), "object", x.err)), (F.lit(True), Value(F.lit(None), "null", x.err))]


def dispatch(f: Callable[..., Value], *xs: Value) -> Value:
    """f of values, by the kind of each where it is known only at run time."""
    if all(x.kind != "any" for x in xs):
        return f(*xs)
    cases = []
    for picks in itertools.product(*map(_branches, xs)):
        conds = [c for c, _ in picks if c is not None]
        cases.append((functools.reduce(lambda a, b: a & b, conds), f(*[v for _, v in picks])))
    kinds = {r.kind for _, r in cases if r.kind != "null"}
    if not kinds:
        kind, wrap = "null", lambda r: F.lit(None).cast("string")
    elif len(kinds) == 1:
        kind = kinds.pop()
        wrap = lambda r: r.col if r.kind != "null" else F.lit(None)
    elif kinds == {"int", "big"}:
        kind, wrap = "big", lambda r: r.col.cast(BIG)
    else:
        kind, wrap = "any", as_variant
    col = err = None
    for cond, r in cases:
        e = r.err if r.err is not None else F.lit(None).cast("string")
        col = F.when(cond, wrap(r)) if col is None else col.when(cond, wrap(r))
        err = F.when(cond, e) if err is None else err.when(cond, e)
    return Value(col, kind, err)


def _errors(*xs: Value) -> Column | None:
    es = [x.err for x in xs if x.err is not None]
    return F.coalesce(*es) if es else None


def _also(err: Column | None, cond: Column, text: str) -> Column:
    own = F.when(cond, F.lit(text))
    return own if err is None else F.coalesce(err, own)


def _binary(op: str, a: Value, b: Value) -> Value:
    return dispatch(lambda x, y: _binary_of(op, x, y), a, b)


_TOO_LARGE = "integer of more than 38 digits"


def _whole(op: str, a: Value, b: Value, err: Column | None) -> Value:
    """+ - * of whole numbers: in 64 bits where the operands' bounds allow it, else in 38 digits."""
    bits = a.bits + b.bits if op == "*" else max(a.bits, b.bits) + 1
    f: Callable = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op]
    both = a.col.isNotNull() & b.col.isNotNull()
    wide = f(a.col.cast(BIG), b.col.cast(BIG)).cast(BIG)
    if a.kind == b.kind == "int":
        x, y = a.col.cast("long"), b.col.cast("long")
        if bits <= 63:
            return Value(f(x, y), "int", err, bits=bits)
        wide = F.coalesce(f(x, y).cast(BIG), wide)
    return Value(wide, "big", _also(err, wide.isNull() & both, _TOO_LARGE))


def _power(a: Value, n: int, err: Column | None) -> Value:
    """a ** n by squaring, exact up to 38 digits."""
    out, square = Value(F.lit(1).cast("long"), "int", err, bits=1), a
    while n:
        if n & 1:
            out = _whole("*", out, square, _errors(out, square))
        n >>= 1
        if n:
            square = _whole("*", square, square, square.err)
    return Value(F.when(a.col.isNotNull(), out.col), out.kind, out.err, bits=out.bits)


def _binary_of(op: str, a: Value, b: Value) -> Value:
    err, num = _errors(a, b), NUMBERS
    if op in ("&&", "||", "^^") and a.kind == b.kind == "bool":
        return Value({"&&": a.col & b.col, "||": a.col | b.col, "^^": a.col != b.col}[op], "bool", err)
    if op in ("==", "!=", "<", ">", "<=", ">=") and (a.kind == b.kind and a.kind not in ("array", "object", "null") or {a.kind, b.kind} <= num):
        x, y = a.col, b.col
        if "float" in (a.kind, b.kind) and a.kind != b.kind:  # exact, where a double would round the integer
            i, f = (x, y) if a.kind != "float" else (y, x)
            small = F.abs(f) < F.lit(1e18)
            fd = F.when(small, f).cast("decimal(38,18)")
            ip = F.when(F.abs(i) < F.lit(str(10**19)).cast(BIG), i).cast("decimal(38,18)")
            sign = F.when(small & f.isNotNull(), F.when(i.cast(BIG) >= F.lit(str(10**19)).cast(BIG), F.lit(1)).when(i.cast(BIG) <= -F.lit(str(10**19)).cast(BIG), F.lit(-1)).when(ip < fd, F.lit(-1)).when(ip > fd, F.lit(1)).otherwise(F.lit(0))).otherwise(F.when(f > i.cast("double"), F.lit(-1)).when(f < i.cast("double"), F.lit(1)).when(F.isnan(f), F.lit(-1)).otherwise(F.lit(0)))
            sign = sign if a.kind != "float" else -sign
            x, y = F.when(i.isNotNull() & f.isNotNull(), sign), F.lit(0)
        return Value({"==": x == y, "!=": x != y, "<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[op], "bool", err)
    if {a.kind, b.kind} <= num:
        if op in ("+", "-", "*", "/", "**") and "float" in (a.kind, b.kind):
            x, y = a.col.cast("double"), b.col.cast("double")
            if op == "/":
                zero = F.when(x == 0, F.lit(float("nan"))).when(F.isnan(x), x).when(x > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
                return Value(F.when(y == 0, zero).otherwise(F.try_divide(x, y)), "float", err)
            return Value({"+": x + y, "-": x - y, "*": x * y, "**": F.pow(x, y)}[op], "float", err)
        if op in ("+", "-", "*"):
            return _whole(op, a, b, err)
        if op in ("/", "%"):
            if a.kind == b.kind == "int":
                x, y = a.col.cast("long"), b.col.cast("long")
                safe = F.when(y != 0, y)
                got = _div(x, safe) if op == "/" else F.when(y == -1, F.lit(0).cast("long")).otherwise(F.try_mod(x, safe))
                over = (y == 0) | (F.lit(op == "/") & (x == F.lit(-(1 << 63))) & (y == -1))
                return Value(got, "int", _also(err, over, "Division by Zero"))
            x, y = a.col.cast(BIG), b.col.cast(BIG)
            rest = F.try_mod(x, F.when(y != 0, y)).cast(BIG)
            got = rest if op == "%" else F.try_divide((x - rest).cast(BIG), F.when(y != 0, y)).cast(BIG)
            return Value(got, "big", _also(_also(err, y == 0, "Division by Zero"), got.isNull() & x.isNotNull() & (y != 0), _TOO_LARGE))
        if op == "**":
            if b.number is not None and 0 <= b.number <= 126:
                return _power(a, b.number, err)
            x, y = a.col.cast("long"), b.col.cast("long")
            p = F.pow(x.cast("double"), y.cast("double"))
            bad = (y < 0) | (F.abs(p) > 9e15)
            return Value(F.when(~bad, F.round(p).cast("long")), "int", _also(err, bad, "exponent out of range"))
        if a.kind == b.kind == "int":
            x, y = a.col.cast("long"), b.col
            if op in ("<<", ">>"):
                name = "shiftleft" if op == "<<" else "shiftright"
                return Value(F.call_function(name, x, y.cast("int")), "int", err)
            return Value({"&": x.bitwiseAND, "|": x.bitwiseOR, "^": x.bitwiseXOR}[op](y.cast("long")), "int", err)
    if op == "+" and a.kind == b.kind == "str":
        return Value(F.concat(a.col, b.col), "str", err)
    text = F.lit(f"invalid operands for binary op: `{a.kind}` {op} `{b.kind}`")
    return Value(F.lit(None), "null", text if err is None else F.coalesce(err, text))


def _div(x: Column, y: Column) -> Column:
    """Truncating integer division, for y that isn't zero."""
    rest = F.try_mod(x, y)
    return F.when((x == F.lit(-(1 << 63))) & (y == -1), F.lit(None)).otherwise(F.try_divide((x - rest).cast("decimal(20,0)"), y.cast("decimal(20,0)")).cast("long"))


def to_int(x: Value) -> Value:
    """Whole numbers in text without blanks; numbers lose their fraction; false and true are 0 and 1."""
    return dispatch(_to_int, x)


def to_float(x: Value) -> Value:
    return dispatch(_to_float, x)


def _to_int(x: Value) -> Value:
    if x.kind in ("int", "big"):
        return x
    if x.kind == "bool":
        return Value(x.col.cast("long"), "int", x.err)
    if x.kind == "float":
        got = F.when(F.isnan(x.col) | (F.abs(x.col) >= 9.2e18), F.lit(None)).otherwise(x.col).cast("long")
        return Value(got, "int", _also(x.err, got.isNull() & x.col.isNotNull(), "cannot convert float to int"))
    if x.kind in ("str", "bytes"):
        s = x.col.cast("string")
        got = F.when(s.rlike(r"^[+-]?[0-9]+\z"), s.try_cast("long"))
        return Value(got, "int", _also(x.err, got.isNull() & s.isNotNull(), "failed to parse value as int"))
    return Value(F.lit(None).cast("long"), "int", _also(x.err, F.lit(True), f"cannot cast {x.kind} to int"))


def _to_float(x: Value) -> Value:
    if x.kind in ("int", "big", "float", "bool"):
        return Value(x.col.cast("double") if x.kind != "bool" else x.col.cast("int").cast("double"), "float", x.err)
    if x.kind in ("str", "bytes"):
        s = x.col.cast("string")
        got = F.when(s.rlike(r"^[+-]?([0-9]+\.?[0-9]*([eE][+-]?[0-9]+)?|\.[0-9]+([eE][+-]?[0-9]+)?|inf|nan|Infinity|NaN)\z"), s.try_cast("double"))
        return Value(got, "float", _also(x.err, got.isNull() & s.isNotNull(), "failed to parse value as float"))
    return Value(F.lit(None).cast("double"), "float", _also(x.err, F.lit(True), f"cannot cast {x.kind} to float"))


def _text(f: Callable) -> Callable:
    def one(x: Value) -> Value:
        from weirflow.functions.formats import show

        return Value(f(show(x)), "str", x.err)

    return one


FUNCTIONS: dict[str, Callable] = {
    "int": to_int, "float": to_float, "str": _text(lambda c: c), "text": _text(lambda c: c), "bytes": lambda x: Value(x.col.cast("string").cast("binary"), "bytes", x.err),
    "trim": _text(lambda c: F.regexp_extract(c, r"(?sU)^\s*(.*?)\s*\z", 1)), "upper": _text(F.upper), "lower": _text(F.lower),
    "big": lambda x: Value(x.col.cast(BIG), "big", x.err),
}


def array_of(xs: list[Value]) -> Value:
    """An array of values: of their type if it is one, of double for whole and other numbers, else of VARIANT."""
    kinds = {x.kind for x in xs if x.kind != "null"}
    types = {type_of(x).simpleString(): type_of(x) for x in xs if x.kind != "null"}
    if len(types) <= 1:
        t = next(iter(types.values()), T.StringType())
    elif kinds == {"int"}:
        t = T.LongType()
    elif kinds == {"int", "big"}:
        t = T.DecimalType(38, 0)
    else:
        t = T.VariantType()
    cols = [as_variant(x) if isinstance(t, T.VariantType) else x.col.cast(t) for x in xs]
    return Value(F.array(*cols) if cols else F.array().cast(T.ArrayType(t)), "array", _errors(*xs), T.ArrayType(t))


def member(v: Value, key: str) -> Value:
    """The value of a key of an object; null for a key that it lacks."""
    if v.kind == "any":
        got = F.try_variant_get(v.col, f"$['{key}']", "variant")
        bad = ~dynamic_kind(v.col).isin("object", "null")
        return Value(got, "any", _also(v.err, bad, f"cannot access key `{key}` of a value that is no object"))
    if isinstance(v.t, T.StructType):
        field = next((f for f in v.t.fields if f.name == key), None)
        return Value(F.lit(None), "null", v.err) if field is None else typed_value(v.col[key], field.dataType, v.err)
    if isinstance(v.t, T.MapType):
        return typed_value(F.try_element_at(v.col, F.lit(key)), v.t.valueType, v.err)
    return Value(F.lit(None), "null", _also(v.err, F.lit(True), f"cannot access key `{key}` of {v.kind}"))


def element(v: Value, i: Value) -> Value:
    """The element of an array at a place from 0, or of an object at a key; null where there is none."""
    err = _errors(v, i)
    if v.kind == "any":
        return Value(F.get(F.try_variant_get(v.col, "$", "array<variant>"), i.col.cast("int")), "any", _also(err, dynamic_kind(v.col) != "array", "cannot index a value that is no array"))
    if isinstance(v.t, T.ArrayType):
        return typed_value(F.get(v.col, i.col.cast("int")), v.t.elementType, err)
    if isinstance(v.t, T.MapType) and i.kind == "str":
        return typed_value(F.try_element_at(v.col, i.col), v.t.valueType, err)
    return Value(F.lit(None), "null", _also(err, F.lit(True), f"cannot index {v.kind} by {i.kind}"))


def _unary(op: str, x: Value) -> Value:
    if op == "!" and x.kind == "bool":
        return Value(~x.col, "bool", x.err)
    if x.kind not in NUMBERS or op in "~!" and x.kind != "int":
        return Value(F.lit(None), "null", _also(x.err, F.lit(True), f"invalid operand for unary op: {op} `{x.kind}`"))
    if op == "-" and x.kind == "int":
        got = F.try_subtract(F.lit(0).cast("long"), x.col.cast("long"))
        return Value(got, "int", x.err if x.bits < 63 else _also(x.err, got.isNull() & x.col.isNotNull(), "integer overflow in `-`: convert the operand with big()"), bits=x.bits)
    return Value({"-": -x.col, "+": x.col, "~": F.bitwise_not(x.col), "!": F.bitwise_not(x.col)}[op], x.kind, x.err)


def compile_expression(text: str, lookup: Callable[[str], Value | None]) -> Value:
    """lookup gives a name's value, `_` being the current one; None: unknown, which is a null."""
    toks, at = [], 0
    while at < len(text.rstrip()):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"unexpected text at {at} in expression: {text}")
        toks.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    toks.append(("end", ""))
    pos, scope = [0], [{}]

    def peek(k: int = 0) -> str:
        return toks[min(pos[0] + k, len(toks) - 1)][1]

    def take(want: str | None = None) -> tuple[str, str]:
        t = toks[pos[0]]
        if want is not None and t[1] != want:
            raise ValueError(f"expected {want!r}, found {t[1]!r} in expression: {text}")
        pos[0] += 1
        return t

    def items(end: str) -> list[Value]:
        out = []
        while peek() != end:
            out.append(binary(0))
            if peek() == ",":
                take()
        take(end)
        return out

    def block() -> Value:
        take("{")
        v = statements("}")
        take("}")
        return v

    def atom() -> Value:
        kind, tok = take()
        if kind == "int":
            n = int(tok.replace("_", ""))
            if n >= 10**38:
                raise ValueError(f"{_TOO_LARGE}: {tok}")
            return Value(F.lit(n).cast("long") if n < 1 << 63 else F.lit(str(n)).cast(BIG), "int" if n < 1 << 63 else "big", bits=n.bit_length(), number=n)
        if kind == "float":
            return Value(F.lit(float(tok.replace("_", ""))), "float")
        if kind == "str":
            from weirflow.functions.literals import parse

            return Value(F.lit(parse(tok)), "str")
        if kind == "name":
            if tok in ("true", "false"):
                return Value(F.lit(tok == "true"), "bool")
            if tok in ("null", "undefined"):
                return Value(F.lit(None), "null")
            if tok == "if":
                c, yes = binary(0), block()
                no = Value(F.lit(None), "null")
                if peek() == "else":
                    take()
                    no = atom() if peek() == "if" else block()
                err = F.when(c.col, yes.err if yes.err is not None else F.lit(None).cast("string")).otherwise(no.err if no.err is not None else F.lit(None).cast("string"))
                err = _errors(c, Value(c.col, "null", err)) if yes.err is not None or no.err is not None else c.err
                if "null" not in (yes.kind, no.kind) and type_of(yes) != type_of(no):
                    return Value(F.when(c.col, as_variant(yes)).otherwise(as_variant(no)), "any", err)
                some = no if yes.kind == "null" else yes
                return Value(F.when(c.col, yes.col).otherwise(no.col), some.kind, err, some.t)
            if peek() == "(" and tok in FUNCTIONS:
                take()
                args = items(")")
                if len(args) != 1:
                    raise ValueError(f"{tok}() takes one argument, got {len(args)}")
                return dispatch(FUNCTIONS[tok], args[0])
            if peek() == "(":
                raise ValueError(f"unknown function {tok}()")
            for s in reversed(scope):
                if tok in s:
                    return s[tok]
            return lookup(tok) or Value(F.lit(None), "null")
        if tok == "(":
            v = binary(0)
            take(")")
            return v
        if tok == "[":
            return array_of(items("]"))
        if tok == "{":
            keys, vals = [], []
            while peek() != "}":
                if peek() == "[":  # a key that is computed
                    take()
                    keys.append(binary(0))
                    take("]")
                else:
                    keys.append(take()[1].strip("\"'"))
                take(":")
                vals.append(binary(0))
                if peek() == ",":
                    take()
            take("}")
            if all(isinstance(k, str) for k in keys):
                fields = [T.StructField(k, type_of(v)) for k, v in zip(keys, vals, strict=True)]
                return Value(F.struct(*[v.col.cast(f.dataType).alias(k) for k, v, f in zip(keys, vals, fields, strict=True)]), "object", _errors(*vals), T.StructType(fields))
            from weirflow.functions.formats import show

            names = [Value(F.lit(k), "str") if isinstance(k, str) else k for k in keys]
            of = array_of(vals)
            return Value(F.map_from_arrays(F.array(*[show(k) for k in names]), of.col), "object", _errors(*names, *vals), T.MapType(T.StringType(), of.t.elementType))
        raise ValueError(f"unexpected {tok!r} in expression: {text}")

    def postfix() -> Value:
        v = atom()
        while peek() in (".", "["):
            if take()[1] == ".":
                v = member(v, take()[1])
            else:
                i = binary(0)
                take("]")
                v = element(v, i)
        return v

    def unary() -> Value:
        if peek() in ("-", "+", "~", "!"):
            op = take()[1]
            return dispatch(lambda x: _unary(op, x), unary())
        return postfix()

    def binary(least: int) -> Value:
        a = unary()
        while _LEVELS.get(peek(), 0) > least:
            op = take()[1]
            a = _binary(op, a, binary(_LEVELS[op]))
        return a

    def statements(end: str) -> Value:
        scope.append({})
        v = Value(F.lit(None), "null")
        while peek() != end:
            if peek() == "let":
                take()
                name = take()[1]
                take("=")
                scope[-1][name] = binary(0)
            else:
                v = binary(0)
            if peek() == ";":
                take()
            elif peek() != end:
                raise ValueError(f"unexpected {peek()!r} in expression: {text}")
        scope.pop()
        return v

    return statements("")
