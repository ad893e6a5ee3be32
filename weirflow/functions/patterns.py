"""Regular expressions: from the pipeline language's dialect to Java's."""

from __future__ import annotations

import re
from dataclasses import dataclass


@dataclass(frozen=True)
class Pattern:
    java: str
    #: Name of each capture group in order; its number if it has none, "" for the group that becomes the output.
    groups: tuple[str, ...]
    #: For each of these groups, where one can stay unmatched while the pattern matches, the numbers of two groups, one of which
    #: holds a neighbouring character if the group has taken part and is empty.
    marks: tuple[tuple[int, int], ...]


def translate(text: str, ignore_case: bool = False, multi_line: bool = False, dot_all: bool = False, ascii_only: bool = False) -> Pattern:
    """The pattern in Java's dialect. A back-reference to a group fails where the group has had no part in the match and holds where
    it is empty, so look-aheads after the pattern, which take nothing, tell one from the other.

    Without the multi-line flag `$` is the end of the text only; `.` leaves out the line feed alone; classes are Unicode's
    unless ascii_only. Group names are dropped, as Java's may not hold `_`. Look-around and back-references are errors."""
    optional = bool(re.search(r"\)[?*{]|\|", text))
    out, names, i, in_class = [], [], 0, 0

    def group(name: str) -> None:
        out.append(f"(?<w{len(names)}>" if optional else "(")
        names.append(name)

    while i < len(text):
        c = text[i]
        if c == "\\":
            nxt = text[i + 1 : i + 2]
            if nxt.isdigit() and nxt != "0" and not in_class:
                raise ValueError(f"back-references are not part of the dialect: {text}")
            out.append(text[i : i + 2])
            i += 2
            continue
        if in_class:
            in_class += (c == "[") - (c == "]")
            out.append("\\&" if c == "&" and text[i + 1 : i + 2] != "&" and text[i - 1] != "&" else c)
        elif c == "[":
            in_class = 1
            out.append(c)
            if text[i + 1 : i + 3] == "^]" or text[i + 1 : i + 2] == "]":
                k = text.index("]", i + 1)
                out.append(text[i + 1 : k] + "\\]")
                i = k
        elif c == "$" and not multi_line:
            out.append("\\z")
        elif c == "(":
            if m := re.match(r"\(\?P?<([^=!][^>]*|)>", text[i:]):
                group(m[1])
                i += m.end()
                continue
            if re.match(r"\(\?(<?[=!])", text[i:]):
                raise ValueError(f"look-around is not part of the dialect: {text}")
            if text.startswith("(?", i):
                out.append(c)
            else:
                group(str(len(names) + 1))
        else:
            out.append(c)
        i += 1
    flags = "d" + "U" * (not ascii_only) + "i" * ignore_case + ("u" if ignore_case and not ascii_only else "") + "m" * multi_line + "s" * dot_all
    n = len(names)
    tests = [rf"(?:(?=\k<w{k}>([\s\S]))|(?=\k<w{k}>)(?<=([\s\S]))|)" for k in range(n)] if optional else []
    body = "".join(out)
    return Pattern(f"(?{flags})" + (f"(?:{body}){''.join(tests)}" if tests else body), tuple(names), tuple((n + 1 + 2 * k, n + 2 + 2 * k) for k in range(len(tests))))
