"""Rule texts, line by line.

Quoted fields hold anything but a quote; a field of one escaped quote is that quote with its backslash. A line
may end in blanks and a comment of two slashes. Comments of several lines start a line and end one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass


class RuleError(ValueError):
    """A line that is no rule, with its number and text."""

    def __init__(self, name: str, number: int, line: str, why: str = "not a rule"):
        super().__init__(f"{name}, line {number}: {why}: {line!r}")
        self.name, self.number, self.line, self.why = name, number, line, why


_FIELD = r'"(\\"|[^"]*)"'
_END = r"[ \t]*(?://.*)?"
_KINDS = {
    "rule": re.compile(rf"{_FIELD}[ \t]+{_FIELD}[ \t]+{_FIELD}[ \t]+{_FIELD}{_END}"),
    "blank": re.compile(_END),
    "folding": re.compile(rf"(.)=(.){_END}"),
    "include": re.compile(rf"#include ([\w-]+){_END}"),
    "language": re.compile(rf"([A-Za-z]+){_END}"),
    "detection": re.compile(rf"([^ ]+) ([^ ]+) (true|false){_END}"),
}


@dataclass(frozen=True)
class Line:
    number: int
    kind: str
    parts: tuple[str, ...]


def lines(name: str, text: str, kinds: tuple[str, ...]) -> Iterator[Line]:
    """What each line of ``text`` is, of the given kinds; comments and blank lines are left out."""
    rows = [r.removesuffix("\r") for r in text.split("\n")]
    at = 0
    while at < len(rows):
        row, start = rows[at], at
        at += 1
        for kind in kinds:
            if m := _KINDS[kind].fullmatch(row):
                yield Line(start + 1, kind, m.groups())
                break
        else:
            if _KINDS["blank"].fullmatch(row):
                continue
            if not row.startswith("/*"):
                raise RuleError(name, start + 1, row)
            while "*/" not in row:
                if at == len(rows):
                    raise RuleError(name, start + 1, rows[start], "comment without an end")
                row = rows[at]
                at += 1
            if row.partition("*/")[2].strip():
                raise RuleError(name, at, row, "text after a comment")
