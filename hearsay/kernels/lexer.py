"""Ordered regular expressions as a lexer: at each place the first that matches decides."""

from __future__ import annotations

import re


class Lexer:
    """rules: (pattern, output) in order; an output of None stands for the matched text."""

    def __init__(self, rules: tuple[tuple[str, str | None], ...]):
        self._outputs = [out for _, out in rules]
        self._any = re.compile("|".join(f"({p})" for p, _ in rules), re.S)

    def outputs(self, text: str):
        """What each matched place puts out."""
        for m in self._any.finditer(text):
            out = self._outputs[m.lastindex - 1]
            yield m[0] if out is None else out

    def encode(self, text: str) -> str:
        return "".join(self.outputs(text))


def letters(text: str) -> str:
    """Letters only, in upper case."""
    return "".join(filter(str.isalpha, text)).upper()
