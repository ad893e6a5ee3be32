"""Format strings: text with {keys} to a Column and its error Column."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from weirflow.functions.expressions import Value, dynamic_kind

_SPEC = re.compile(r"(?:(?P<fill>.)?(?P<align>[<^>]))?(?P<sign>\+)?(?P<pretty>\#{1,2})?(?P<zero>0(?![boxX]))?(?P<width>[1-9]\d*|[A-Za-z_%@][\w@]*\$)?(?:\.(?P<prec>\d+|[A-Za-z_%@][\w@]*\$))?_?(?P<kind>\?\?|\?|0b|0o|0x|0X|b|o|x|X|e|E)?", re.S)


@dataclass
class Key:
    name: str
    spec: dict


def split_format(text: str) -> list[str | Key]:
    """Literal parts and keys; doubled braces are literal."""
    out: list[str | Key] = [""]
    i = 0
    while i < len(text):
        c = text[i]
        if text[i : i + 2] in ("{{", "}}"):
            out[-1] += c
            i += 2
        elif c == "{":
            end = text.find("}", i)
            if end < 0:
                raise ValueError(f"unterminated key in format string: {text}")
            name, _, spec = text[i + 1 : end].partition(":")
            m = _SPEC.fullmatch(spec)
            if not m:
                raise ValueError(f"bad format key {text[i : end + 1]}")
            out += [Key(name, m.groupdict()), ""]
            i = end + 1
        elif c == "}":
            raise ValueError(f"unmatched }} in format string: {text}")
        else:
            out[-1] += c
            i += 1
    return [x for x in out if x != ""]


def show(v: Value) -> Column:
    """Plain text of a value, null where it has none. Whole doubles have no fraction part."""
    if v.kind == "any":
        kind, text = dynamic_kind(v.col), F.try_variant_get(v.col, "$", "string")
        return F.when(kind == "float", show(Value(F.try_variant_get(v.col, "$", "double"), "float"))).when(kind.isin("array", "object"), _nested(F.to_json(v.col), None)).otherwise(text)
    if v.kind == "float":
        d = v.col.cast("double")
        whole = (F.floor(d) == d) & (F.abs(d) < 1e15)
        return F.when(F.isnan(d), F.lit("nan")).when(d == float("inf"), F.lit("inf")).when(d == float("-inf"), F.lit("-inf")).when(whole, d.cast("long").cast("string")).otherwise(d.cast("string"))
    if v.kind in ("array", "object"):
        return typed(v)
    return v.col.cast("string")


def _quoted(s: Column) -> Column:
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return F.concat(F.lit('"'), s, F.lit('"'))


def typed(v: Value, layout: str | None = None) -> Column:
    """The value in literal notation. layout: `#` puts the members of arrays and objects on lines of their own, `##` leaves out blanks."""
    if v.kind == "any":
        kind = dynamic_kind(v.col)
        whole = _nested(F.to_json(v.col), layout)
        return F.when(kind == "str", _quoted(F.try_variant_get(v.col, "$", "string"))).when(kind.isin("array", "object"), whole).otherwise(F.coalesce(show(v), F.lit("null")))
    if v.kind == "str":
        return F.coalesce(_quoted(v.col), F.lit("null"))
    if v.kind in ("array", "object"):
        options = {"ignoreNullFields": "false"} | ({"pretty": "true"} if layout == "#" else {})
        return F.coalesce(_nested(F.to_json(v.col, options), layout), F.lit("null"))
    return F.coalesce(show(v), F.lit("null"))


def _nested(text: Column, layout: str | None) -> Column:
    """JSON text in literal notation: bare keys, a blank after each comma and colon unless the layout says otherwise."""
    if layout == "#":
        return F.regexp_replace(text, r'"([A-Za-z_][A-Za-z0-9_]*)" : ', "$1: ")
    if layout is None:
        text = F.regexp_replace(text, r'("(?:[^"\\]|\\.)*")|([,:])', "$1$2 ")
        text = F.regexp_replace(text, r'" (?=[:,\],}])', '"')
        return F.regexp_replace(text, r'("(?:[^"\\]|\\.)*"(?!:))|"([A-Za-z_][A-Za-z0-9_]*)"(?=: )', "$1$2")
    return F.regexp_replace(text, r'("(?:[^"\\]|\\.)*"(?!:))|"([A-Za-z_][A-Za-z0-9_]*)"(?=:)', "$1$2")


def _let(x: Column, body: Callable[[Column], Column]) -> Column:
    """body(x), with x worked out once however often body names it."""
    return F.transform(F.array(x), body)[0]


def _scientific(v: Value, upper: bool) -> Column:
    """One digit, the others after a point, and the power of ten: 4.2e1. Text that is named often in a column is written out and worked
    out as often, and code of more than 8000 bytes is never compiled by the JVM: so whole numbers take one replacement, and what is
    named again elsewhere is bound."""
    e = "E" if upper else "e"
    if v.kind in ("int", "big"):
        s = v.col.cast("string")
        digits = F.replace(F.regexp_replace(s, "^(-?[0-9])([0-9]*?)0*$", f"$1.$2{e}"), F.lit(f".{e}"), F.lit(e))
        return F.concat(digits, (F.length(s) - F.when(v.col < 0, 2).otherwise(1)).cast("string"))

    def parts(s: Column, mantissa: Column) -> Column:
        digits = F.replace(mantissa, F.lit("."), F.lit(""))
        return _let(digits, lambda d: _let(F.regexp_replace(d, "^0+|0+$", ""), lambda kept: text(s, mantissa, d, kept)))

    def text(s: Column, mantissa: Column, digits: Column, kept: Column) -> Column:
        power = F.when(s.contains("E"), F.coalesce(F.regexp_extract(s, r"E(-?[0-9]+)$", 1).try_cast("int"), F.lit(0))).otherwise(F.lit(0))
        lead = F.length(digits) - F.length(F.ltrim(digits, F.lit("0")))
        point = F.locate(".", mantissa)
        whole = F.when(point > 0, point - 1).otherwise(F.length(mantissa))
        rest = F.when(F.length(kept) > 1, F.concat(F.lit("."), F.substring(kept, F.lit(2), F.length(kept)))).otherwise(F.lit(""))
        shown = F.concat(F.when(s.startswith("-"), F.lit("-")).otherwise(F.lit("")), F.substring(kept, 1, 1), rest, F.lit(e), (power + whole - 1 - lead).cast("string"))
        return F.when(kept == "", F.lit(f"0{e}0")).otherwise(shown)

    s = v.col.cast("double").cast("string") if v.kind == "float" else v.col.cast("string")
    number = _let(s, lambda s: _let(F.regexp_extract(s, r"^-?([0-9.]+)", 1), lambda mantissa: parts(s, mantissa)))
    return F.when(s.rlike("^-?(NaN|Infinity)$"), show(v)).otherwise(number)


def _based(v: Value, kind: str) -> Column:
    base, n = {"b": 2, "o": 8, "x": 16, "X": 16}[kind[-1]], (F.try_variant_get(v.col, "$", "bigint") if v.kind == "any" else v.col.cast("long"))
    digits = F.conv(F.abs(n).cast("string"), 10, base)
    digits = F.lower(digits) if kind[-1] != "X" else F.upper(digits)
    return F.concat(F.when(n < 0, F.lit("-")).otherwise(F.lit("")), F.lit(kind if len(kind) == 2 else "").substr(1, 2) if len(kind) == 2 else F.lit(""), digits)


def compile_format(text: str, lookup: Callable[[str], Value | None], atoms: dict[str, object]) -> tuple[Column, Column | None]:
    """(text, error) of a format string. A null or unknown value in a plain key is an error; {:?} shows it."""
    cols, errs = [], []

    def number(ref: str | None) -> Column | None:
        if ref is None:
            return None
        if ref.isdigit():
            return F.lit(int(ref))
        if ref[0] == "%":
            return F.lit(int(atoms[ref[1:-1]]))
        v = lookup(ref[:-1])
        col = v.col.cast("int") if v else F.lit(None).cast("int")
        errs.append(F.when(col.isNull(), F.lit(f"unexpected type 'undefined' in format key width '{ref[:-1]}'")))
        return col

    for part in split_format(text):
        if isinstance(part, str):
            cols.append(F.lit(part))
            continue
        if part.name.startswith("%"):
            if part.name[1:] not in atoms:
                raise ValueError(f"unknown atom {part.name}")
            const = atoms[part.name[1:]]
            v = Value(F.lit(const), "bool" if isinstance(const, bool) else "int" if isinstance(const, int) else "float" if isinstance(const, float) else "str")
        else:
            v = lookup(part.name.removeprefix("@") or "_") or Value(F.lit(None), "undefined")
        s, kind = part.spec, part.spec["kind"] or ""
        if kind in ("?", "??"):
            whole = F.lit("undefined") if v.kind == "undefined" else typed(v, s["pretty"])
            shown = whole if v.err is None else F.when(v.err.isNotNull(), F.concat(F.lit('(error)"'), v.err, F.lit('"'))).otherwise(whole)
        else:
            if v.err is not None:
                errs.append(v.err)
            name = "undefined" if v.kind == "undefined" else "null"
            errs.append(F.when(v.col.isNull(), F.lit(f"unexpected type '{name}' in format key '{part.name}'")))
            if kind in ("x", "X") and s["pretty"] == "#":
                kind = f"0{kind}"
            if kind in ("e", "E"):
                shown = _scientific(v, kind == "E")
            elif kind:
                shown = _based(v, kind)
            else:
                shown = typed(v, s["pretty"]) if s["pretty"] and v.kind in ("array", "object") else show(v)
            prec = number(s["prec"])
            if prec is not None and v.kind == "float":
                fixed = F.call_function("printf", F.concat(F.lit("%."), prec.cast("string"), F.lit("f")), v.col.cast("double"))
                shown = F.when(F.isnan(v.col) | (F.abs(v.col) == float("inf")), shown).otherwise(fixed)
            elif prec is not None and v.kind == "str":
                shown = F.substring(shown, F.lit(1), prec)
            if s["sign"] and v.kind in ("int", "float", "big"):
                shown = F.when(v.col >= 0, F.concat(F.lit("+"), shown)).otherwise(shown)
            elif s["sign"] and v.kind == "any":
                shown = F.when(F.try_variant_get(v.col, "$", "double") >= 0, F.concat(F.lit("+"), shown)).otherwise(shown)
        width = number(s["width"])
        if width is not None:
            gap = F.greatest(width - F.length(shown), F.lit(0))
            pad = lambda n, c: F.repeat(F.lit(c), n)
            if s["zero"] and not s["align"]:
                sign = F.regexp_extract(shown, "^[+-]?", 0)
                shown = F.concat(sign, pad(gap, "0"), F.substring(shown, F.length(sign) + 1, F.length(shown)))
            else:
                fill, align = s["fill"] or " ", s["align"] or "<"
                left = {"<": F.lit(0), ">": gap, "^": F.ceil(gap / 2).cast("int")}[align]
                shown = F.concat(pad(left, fill), shown, pad(gap - left, fill))
        cols.append(F.coalesce(shown, F.lit("")))
    err = F.coalesce(*errs) if errs else None
    out = F.concat(*cols) if cols else F.lit("")
    return (out if err is None else F.when(err.isNull(), out)), err
