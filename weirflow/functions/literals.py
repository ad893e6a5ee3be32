"""The literal notation: numbers, strings, bytes, arrays and objects with bare keys."""

from __future__ import annotations

import math
import re
from typing import Any

_TOKEN = re.compile(r"""\s*(?:(?P<num>[+-]?(?:inf|nan|(?:\d[\d_]*)?\.?\d[\d_]*(?:[eE][+-]?\d+)?|\d[\d_]*\.))(?![A-Za-z0-9_])|(?P<str>b?"(?:[^"\\]|\\.)*"|b?'(?:[^'\\]|\\.)*')|(?P<name>[A-Za-z_@][A-Za-z0-9_@-]*)|(?P<mark>[\[\]{},:()]))""", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "\\": "\\", "'": "'", '"': '"'}


class LiteralError(ValueError):
    """The text isn't a literal."""


def _string(tok: str) -> Any:
    is_bytes = tok[0] == "b"
    body = re.sub(r"\\(u\{[0-9A-Fa-f]+\}|u[0-9A-Fa-f]{4}|x[0-9A-Fa-f]{2}|.)", lambda m: chr(int(m[1].strip("ux{}"), 16)) if m[1][0] in "ux" and len(m[1]) > 1 else _ESCAPES.get(m[1], m[1]), tok[1 + is_bytes : -1], flags=re.S)
    return body.encode("latin-1", "replace") if is_bytes else body


def parse(text: str) -> Any:
    """The value of one literal; `undefined` and `null` are None."""
    toks, at = [], 0
    while at < len(text.rstrip()):
        m = _TOKEN.match(text, at)
        if not m or m.end() == at:
            raise LiteralError(f"unexpected text at {at} in literal: {text[:80]}")
        toks.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()

    def value(i: int) -> tuple[Any, int]:
        if i >= len(toks):
            raise LiteralError("literal ends too early")
        kind, tok = toks[i]
        if kind == "num":
            t = tok.replace("_", "")
            return (int(t) if re.fullmatch(r"[+-]?\d+", t) else float(t)), i + 1
        if kind == "str":
            return _string(tok), i + 1
        if kind == "name":
            if tok in ("true", "false"):
                return tok == "true", i + 1
            if tok in ("null", "undefined"):
                return None, i + 1
            if tok in ("inf", "nan"):
                return float(tok), i + 1
            raise LiteralError(f"unknown name {tok!r}")
        if tok == "[":
            out, i = [], i + 1
            while toks[i : i + 1] != [("mark", "]")]:
                v, i = value(i)
                out.append(v)
                if toks[i : i + 1] == [("mark", ",")]:
                    i += 1
                elif toks[i : i + 1] != [("mark", "]")]:
                    raise LiteralError("expected , or ]")
            return out, i + 1
        if tok == "{":
            obj, i = {}, i + 1
            while toks[i : i + 1] != [("mark", "}")]:
                if i + 1 >= len(toks) or toks[i][0] not in ("name", "str") or toks[i + 1] != ("mark", ":"):
                    raise LiteralError("expected key:")
                key = toks[i][1] if toks[i][0] == "name" else _string(toks[i][1])
                obj[key], i = value(i + 2)
                if toks[i : i + 1] == [("mark", ",")]:
                    i += 1
                elif toks[i : i + 1] != [("mark", "}")]:
                    raise LiteralError("expected , or }")
            return obj, i + 1
        raise LiteralError(f"unexpected {tok!r}")

    out, end = value(0)
    if end != len(toks):
        raise LiteralError("text after the literal")
    return out


def quote(text: str) -> str:
    marks = {"\n": "\\n", "\t": "\\t", "\r": "\\r", "\0": "\\0", "\\": "\\\\", '"': '\\"'}
    return '"' + "".join(marks.get(c, c) for c in text) + '"'


def show(v: Any) -> str:
    """A value in literal notation."""
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else ("inf" if v > 0 else "-inf") if math.isinf(v) else str(int(v)) if v == int(v) and abs(v) < 1e16 else repr(v)
    if isinstance(v, str):
        return quote(v)
    if isinstance(v, bytes | bytearray):
        return "b" + quote(bytes(v).decode("latin-1"))
    if isinstance(v, dict):
        return "{" + ", ".join(f"{k if re.fullmatch(r'[A-Za-z_@][A-Za-z0-9_@-]*', k) else quote(k)}: {show(x)}" for k, x in v.items()) + "}"
    if hasattr(v, "asDict"):
        return show(v.asDict())
    if isinstance(v, list | tuple):
        return "[" + ", ".join(map(show, v)) + "]"
    return str(v)


_UNITS = {"k": 10**3, "M": 10**6, "G": 10**9, "T": 10**12, "Ki": 2**10, "Mi": 2**20, "Gi": 2**30}


def whole_number(text: str) -> int:
    """An integer, with a unit such as 10k if it has one."""
    m = re.fullmatch(r"\s*([+-]?\d[\d_]*)\s*([kMGT]i?)?\s*", text)
    if not m:
        raise LiteralError(f"not a whole number: {text!r}")
    return int(m[1].replace("_", "")) * _UNITS.get(m[2] or "", 1)
