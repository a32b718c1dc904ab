"""Metaphone."""

from __future__ import annotations

import re

from hearsay.kernels.lexer import Lexer

# What happens at the start of a word.
_STARTS = ((r"\A[KGP](?=N)", ""), (r"\AA(?=E)", ""), (r"\AW(?=R)", ""), (r"\AWH", "W"), (r"\AX", "S"))

# Fixed values: (letter in its context, code), the first that matches.
_RULES = (
    ("|".join(f"(?<={x}){x}" for x in "ABDEFGHIJKLMNOPQRSTUVWXYZ"), ""),
    (r"\A[AEIOU]", None),
    (r"(?<=M)B\Z", ""),
    ("B", "B"),
    (r"(?<=S)C(?=[EIY])", ""),
    ("C(?=IA)", "X"),
    ("C(?=[EIY])", "S"),
    ("(?<=S)C(?=H)", "K"),
    (r"\AC(?=H[AEIOU].)", "K"),
    ("C(?=H)", "X"),
    ("C", "K"),
    ("DG[EIY]", "J"),
    ("D", "T"),
    (r"G(?=H\Z)", ""),
    ("G(?=H[^AEIOU])", ""),
    ("(?<=.)G(?=N)", ""),
    ("(?<!G)G(?=[EIY])", "J"),
    ("G", "K"),
    (r"H\Z", ""),
    ("(?<=[CSPTG])H", ""),
    ("H(?=[AEIOU])", "H"),
    ("[FJLMNR]", None),
    ("(?<!C)K", "K"),
    ("P(?=H)", "F"),
    ("P", "P"),
    ("Q", "K"),
    ("S(?=H|I[OA])", "X"),
    ("S", "S"),
    ("T(?=I[AO])", "X"),
    ("T(?=CH)", ""),
    ("T(?=H)", "0"),
    ("T", "T"),
    ("V", "F"),
    ("[WY](?=[AEIOU])", None),
    ("X", "KS"),
    ("Z", "S"),
)
_LEXER = Lexer(_RULES)


def metaphone(word: str, max_length: int | None = 4) -> str:
    """At most max_length characters, None: any number. A single ASCII character is its own code."""
    word = word.upper()
    if len(word.encode()) == 1:
        return word
    for pattern, to in _STARTS:
        word, n = re.subn(pattern, to, word, count=1)
        if n:
            break
    return _LEXER.encode(word)[:max_length]
