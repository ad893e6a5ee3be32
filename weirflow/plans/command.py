"""Pipelines in text: one word an operator, `op: ... end` for a body, `op@name` to name its output."""

from __future__ import annotations

import re
import shlex
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from weirflow import operators as O
from weirflow.builder import Pipeline
from weirflow.functions.literals import parse as parse_literal
from weirflow.functions.literals import whole_number
from weirflow.sources import csv, file, jsonl, stdin

SETTINGS = {"bs": 1024, "sst": 1024, "sbs": 8192, "rpm": "cutoff-40", "fpm": False, "lb": "tty", "j": 0, "alcf": 64}


@dataclass
class Call:
    name: str
    args: list[str] = field(default_factory=list)
    flags: set[str] = field(default_factory=set)
    options: dict[str, str] = field(default_factory=dict)
    bodies: list[list[Call]] | None = None
    label: str | None = None
    mode: str = ""


_HEAD = re.compile(r"(?P<mode>[,_]?)(?P<name>%?[A-Za-z~][A-Za-z0-9_~]*)(?P<flags>(?:-[A-Za-z]+(?::(?:[^=@]|$))?)*)(?:@(?P<label>[A-Za-z_]\w*))?(?P<end>:|=(?P<arg>.*)|$)", re.S)


def parse_command(tokens: list[str] | str, macros: dict[str, list[str]] | None = None, spark: SparkSession | None = None) -> list[Call]:
    """The calls of a command. `macro: NAME ... end` gives words a name ({arg} in them is the argument); `macro:=NAME ... end` is a
    command that makes call expressions of its call, for which a session is needed."""
    tokens = shlex.split(tokens) if isinstance(tokens, str) else list(tokens)
    macros = dict(macros or {})
    if spark is not None:
        macros[""] = spark
    calls, at = _calls(tokens, 0, macros, top=True)
    if at != len(tokens):
        raise ValueError(f"`{tokens[at]}` closes nothing")
    return calls


def _calls(tokens: list[str], at: int, macros: dict[str, list[str]], top: bool = False) -> tuple[list[Call], int]:
    out: list[Call] = []
    while at < len(tokens) and tokens[at] not in ("end", "next"):
        tok = tokens[at]
        if tok == "[":
            end = tokens.index("]", at)
            call = _call(tokens[at + 1])
            for a in tokens[at + 2 : end]:
                _argument(call, a)
            at = end + 1
        elif tok.startswith("macro:="):
            end = _closing(tokens, at)
            macros[tok.removeprefix("macro:=")] = ("made", tokens[at + 1 : end])
            at = end + 1
            continue
        else:
            call = _call(tok)
            at += 1
            if call.name in macros and isinstance(macros[call.name], tuple):
                if "" not in macros:
                    raise ValueError(f"macro `{call.name}` needs a session")
                out += expand(macros[""], macros[call.name][1], [call.name, *call.args])
                continue
            if call.name == "macro" and call.bodies is not None:
                depth, start = 1, at + 1
                while depth:
                    at += 1
                    if at >= len(tokens):
                        raise ValueError("macro without end")
                    depth += tokens[at].endswith(":") - (tokens[at] == "end")
                macros[tokens[start - 1]] = tokens[start:at]
                at += 1
                continue
            if call.name in macros:
                inner, _ = _calls([t.replace("{arg}", call.args[0] if call.args else "") for t in macros[call.name]], 0, macros)
                out += inner
                continue
            while at < len(tokens) and call.bodies is None and re.fullmatch(r"-[A-Za-z]+(=.*)?", tokens[at], re.S):
                _argument(call, tokens[at])
                at += 1
        if call.bodies is not None and call.name == "chunks" and not call.args and at < len(tokens) and tokens[at].isdigit():
            call.args.append(tokens[at])
            at += 1
        if call.bodies is not None:
            call.bodies = []
            while True:
                body, at = _calls(tokens, at, macros)
                call.bodies.append(body)
                if at >= len(tokens):
                    break  # an open block ends with the command
                at += 1
                if tokens[at - 1] == "end":
                    break
        if call.mode == ",":
            first = out.pop() if out else Call("nop")
            if first.name == "aggregate" and first.mode == "append":
                first.bodies.append([call])
                call = first
            else:
                call = Call("aggregate", bodies=[[first] if first.name != "nop" else [Call("nop")], [call]], mode="append")
        out.append(call)
    return out, at


def _closing(tokens: list[str], at: int) -> int:
    """The place of the `end` of the block that opens at a place."""
    depth = 1
    while depth:
        at += 1
        if at >= len(tokens):
            raise ValueError("macro without end")
        depth += (tokens[at].endswith(":") or tokens[at].startswith("macro:=")) - (tokens[at] == "end")
    return at


def _argument(call: Call, text: str) -> None:
    """`-f` is a flag, `-n=2` or `n=2` a named argument, anything else a plain one."""
    m = re.fullmatch(r"-([A-Za-z_]+)(?:=(.*))?", text, re.S)
    named = m if m and m[2] is not None else re.fullmatch(r"(n|count|i|insert_count)=(.*)", text)
    if named:
        call.options[named[1]] = named[2]
    elif m:
        call.flags.update(["drop_incomplete"] if m[1] == "drop_incomplete" else m[1])
    else:
        call.args.append(text)


def expand(spark: SparkSession, macro: list[str], call: list) -> list[Call]:
    """The calls that a macro's body makes of its call expression: the body is a command whose input is the expression and whose one
    result is an array of call expressions, each an operator's name and its arguments."""
    from weirflow.records import from_values

    got = run(spark, macro, Pipeline(spark, from_values(spark, [call]))).collect()
    if len(got) != 1 or not isinstance(got[0], list):
        raise ValueError("a macro must give one array of call expressions")
    return [_expression(x) for x in got[0]]


def _expression(x: object) -> Call:
    if isinstance(x, str):
        return _call(x)
    if not isinstance(x, list) or not x or not isinstance(x[0], str):
        raise ValueError(f"not a call expression: {x!r}")
    call = _call(x[0])
    for a in x[1:]:
        if isinstance(a, list):
            call.bodies = [*(call.bodies or [[]])]
            call.bodies[0].append(_expression(a))
        else:
            _argument(call, str(a))
    return call


def _call(tok: str) -> Call:
    if tok == "_":
        return Call("_")
    m = _HEAD.fullmatch(tok)
    if not m:
        raise ValueError(f"cannot read operator {tok!r}")
    call = Call(m["name"], [] if m["arg"] is None else [m["arg"]], label=m["label"], mode=m["mode"])
    for f, v in re.findall(r"-([A-Za-z]+)(?::(.))?", m["flags"] or ""):
        call.flags.update(f)
        if v:
            call.options[f[-1]] = v
    if m["end"] == ":" or call.name == "chunks" and (m["arg"] or "").endswith(":"):
        call.args = [a.removesuffix(":") for a in call.args]
        call.bodies = []
    return call


def _ints(arg: str) -> list[int]:
    return [whole_number(x) for x in arg.split(",")]


def _span(call: Call) -> dict:
    xs = _ints(call.args[0])
    return {"end": xs[0]} if len(xs) == 1 else {"begin": xs[0], "end": xs[1], **({"step": xs[2]} if len(xs) > 2 else {})}


def _one(call: Call, default: str | None = None) -> str:
    if call.args:
        return call.args[0]
    if default is None:
        raise ValueError(f"operator `{call.name}` needs an argument")
    return default


def _tail(call: Call) -> O.Op:
    a = _one(call, "1")
    return O.skip(whole_number(a[1:])) if a.startswith("+") else O.tail(whole_number(a))


def _value(call: Call) -> O.Op:
    return O.literal(parse_literal(_one(call)), whole_number(call.options.get("i", call.options.get("insert_count", "1"))))


#: What shows records on standard output or, with a path, as text files.
PRINTS = ("print", "p", "write", "w")


def _regex(call: Call) -> O.Op:
    f = call.flags
    names = {"i": "ignore_case", "m": "multi", "o": "overlapping", "n": "optional", "f": "full", "v": "invert", "l": "lines", "d": "dot_all", "a": "ascii_only"}
    return O.regex(_one(call), **{n: True for k, n in names.items() if k in f}, **({"ascii_only": True} if "b" in f and "u" not in f and "a" not in f else {}))


def _bodies(call: Call, fpm: bool) -> list[O.Op]:
    return [build(b, fpm) for b in call.bodies or [[]]]


def build(calls: list[Call], fpm: bool = False) -> O.Op:
    """The operator that runs these calls one after another."""
    ops: list[O.Op] = []
    for i, call in enumerate(calls):
        if call.name.startswith("%"):
            name, raw = call.name[1:], _one(call)
            value = whole_number(raw) if re.fullmatch(r"[+-]?\d+[kMGT]?i?", raw) else raw
            fpm = raw in ("true", "1") if name == "fpm" else fpm
            if name == "sbs" and value == 0:
                raise ValueError("setting sbs cannot be zero")
            ops.append(O.atom(name, value))
            continue
        if call.name == "atom":
            if len(call.args) != 2:
                raise ValueError("an atom takes a name and a value")
            call = Call(f"%{call.args[0]}", [call.args[1]])
            ops.append(build([call], fpm))
            continue
        following = [O.chain(build([c], fpm)) for c in calls[i + 1 : i + 8]] if call.name == "primes" else None
        op = _operator(call, following, fpm)
        op = O.transparent(op) if call.mode == "_" else op
        ops.append(O.chain(op, O.key(call.label)) if call.label else op)
    return O.chain(*ops)


def _operator(call: Call, following: list[O.Op] | None, fpm: bool) -> O.Op:
    n = call.name
    simple = {
        "nop": O.nop, "tl": O.nop, "explode": O.explode, "typename": O.typename, "filter": O.filter_, "drop": O.drop, "flatten": O.flatten,
        "eliminate_errors": O.eliminate_errors, "ee": O.eliminate_errors, "lines": O.lines, "l": O.lines, "chars": O.chars, "trim": O.trim,
        "to_tyson": O.to_literal, "to_int": O.to_int_, "to_float": O.to_float_, "to_str": O.to_str, "count": O.count, "avg": O.avg,
        "max": O.max_, "collect": O.collect, "undefined": O.undefined,
    }
    if n in simple:
        return simple[n]()
    if n in PRINTS or n == "fork":
        raise ValueError(f"`{n}` may only end a command")
    if n == "sum":
        return O.sum_(exact=not fpm)
    if n in ("str", "~str"):
        return O.literal(_one(call))
    if n in ("bytes", "~bytes"):
        return O.literal(_one(call).encode())
    if n in ("int", "float", "bool", "v", "value", "tyson", "object", "array"):
        return _value(call)
    if n == "null":
        return O.literal(None)
    if n in ("error", "~error"):
        return O.error(_one(call))
    if n in ("seq", "seqn", "enum", "enumn") and not (n.startswith("enum") and (not call.args or "u" in call.flags)):
        return getattr(O, n)(**_span(call))
    if n in ("enum", "enumn"):
        if "u" in call.flags:
            x = _span(call)
            return O.enum_unbounded(**(x | ({"begin": 1, "end": x["end"] + 1} if n == "enumn" and "begin" not in x else {})))
        return getattr(O, n)()
    if n == "primes":  # unbounded, so what follows must bound it, be it after operators that make one record of one
        bound = next((op.takes for op in following if getattr(op, "takes", None) is not None or not getattr(op, "steady", False)), None) if following else None
        if bound is None:
            raise ValueError("primes never end: follow them by head=N")
        return O.primes(bound)
    if n == "key":
        return O.key(_one(call))
    if n == "select":
        return O.select(_one(call))
    if n == "dup":
        return O.dup(whole_number(_one(call, "2")))
    if n == "head":
        return O.head(whole_number(_one(call, "1")))
    if n == "tail":
        return _tail(call)
    if n in ("regex", "r"):
        return _regex(call)
    if n in ("format", "f"):
        return O.format_(_one(call))
    if n in ("compute", "c"):
        return O.compute(_one(call))
    if n in ("join", "j"):
        size = call.options.get("n", call.options.get("count"))
        return O.join(_one(call, ""), None if size is None else whole_number(size), bool(call.flags & {"d", "drop_incomplete"}))
    if n == "from_tyson":
        return O.from_literal(_one(call, "string"))
    if n == "py":
        return O.py(_one(call))
    if n in ("xpath", "sel_xpath"):  # of static HTML; there is no browser
        return O.xpath(_one(call))
    if n in ("foreach", "fe"):
        return O.foreach(*_bodies(call, fpm))
    if n == "chunks":
        return O.chunks(whole_number(_one(call)), *_bodies(call, fpm))
    if n in ("forkcat", "fc"):
        return O.forkcat(*_bodies(call, fpm))
    if n == "aggregate":
        return O.aggregate(*_bodies(call, fpm))
    if n == "transparent":
        return O.transparent(O.chain(*_bodies(call, fpm)))
    if n in ("call", "callcc"):  # both go on with the chain; Spark runs either in parallel
        return O.call(_one(call))
    if n in PLUGINS:
        return PLUGINS[n](call)
    if n in ("exec", "GET", "http_get"):
        raise ValueError(f"`{n}` reaches out of the cluster and is off")
    raise ValueError(f"unknown operator `{n}`")


#: Operators added by register_op: name -> function from Call to operator.
PLUGINS: dict = {}


def register_op(name: str, parser: object) -> None:
    """Add an operator to the command language."""
    PLUGINS[name] = parser


def run(spark: SparkSession, command: str | list[str], start: Pipeline | None = None) -> Pipeline:
    """The pipeline that a command describes. A file, csv, jsonl or stdin operator at its start reads its source; print or write at its
    end shows the records, and null or an error is what is left of each."""
    calls = parse_command(command, spark=spark)
    last = calls[-1] if calls else None
    if last is not None and last.name in PRINTS:
        p = _started(spark, calls[:-1], start)
        p.write(last.args[0], "n" in last.flags) if last.args else p.print("n" in last.flags)
        return p.printed()
    return _started(spark, calls, start)


def run_fork(spark: SparkSession, command: str | list[str], start: Pipeline | None = None) -> list[Pipeline]:
    """The pipelines of a command that ends in `fork: a next b ... end`, one for each body, all from the same stream."""
    calls = parse_command(command, spark=spark)
    if not calls or calls[-1].name != "fork":
        return [run(spark, command, start)]
    p = _started(spark, calls[:-1], start)
    return p.fork(*_bodies(calls[-1], False))


def _started(spark: SparkSession, calls: list[Call], start: Pipeline | None) -> Pipeline:
    calls = list(calls)
    settings = O.chain(*[O.atom(k, v) for k, v in SETTINGS.items()])
    at = next((i for i, c in enumerate(calls) if not c.name.startswith("%")), len(calls))
    p = start or Pipeline(spark)
    if at < len(calls) and calls[at].name == "_":
        if start is None:
            raise ValueError("`_` needs the output of a command before")
        calls.pop(at)
    if at < len(calls) and calls[at].name in ("file", "csv", "jsonl", "stdin", "in"):
        c = calls.pop(at)
        if c.name == "csv":
            p = Pipeline(spark, csv(spark, _one(c), "h" in c.flags, "r" in c.flags, c.options.get("s", ",")))
        elif c.name == "jsonl":
            p = Pipeline(spark, jsonl(spark, _one(c), "o" in c.flags, "n" in c.flags))
        elif c.name == "file":
            p = Pipeline(spark, file(spark, _one(c)))
        else:
            p = Pipeline(spark, stdin(spark))
    return p.then(settings, build(calls))


class Session:
    """Commands one after another; `_` stands for the output of the one before."""

    def __init__(self, spark: SparkSession):
        self.spark, self.last = spark, None

    def run(self, command: str | list[str]) -> Pipeline:
        uses = (parse_command(command) or [Call("nop")])[0].name == "_"
        self.last = run(self.spark, command, self.last if uses else None)
        return self.last
