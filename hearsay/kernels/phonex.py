"""Phonex."""

from __future__ import annotations

import re

from hearsay.kernels.lexer import letters

# Starts, in order; then what the first letter becomes.
_STARTS = ((r"\A(?:KN|PH|WR)", lambda m: {"KN": "NN", "PH": "FH", "WR": "RR"}[m[0]]), (r"\AH", ""))
_FIRST = str.maketrans("EIOUYPVKQJZ", "AAAAABFCCGS")
# Codes of letters in their context; the group's name is the code, x keeps the one before.
_CODES = re.compile(r"(?P<c1>[BPFV])|(?P<c2>[CSKGJQXZ])|(?P<x>[DT](?=C)|[LR](?=[^AEIOUY]))|(?P<c3>[DT])|(?P<c4>L)|(?P<c5>[MN][DG]?)|(?P<c6>R)|(?P<c0>.)", re.S)


def phonex(word: str, max_length: int = 4) -> str:
    """First letter and codes, filled with 0."""
    word = letters(word).rstrip("S")
    for pattern, to in _STARTS:
        word = re.sub(pattern, to, word)
    word = word[:1].translate(_FIRST) + word[1:]
    out, size, code, last = [], 0, "0", "0"
    for m in _CODES.finditer(word):
        if size == max_length:
            break
        first = m.start() == 0
        if first:
            out.append(word[0])
            size = len(word[0].encode())
        if m.lastgroup != "x":
            code = m.lastgroup[1]
        alone = m.end() == 1  # the first letter takes no code, unless it has a second one with it
        if last != code and code != "0" and not alone:
            out.append(code)
            size += 1
        last = code if alone else out[-1]
    return "".join(out) + "0" * (max_length - size)
