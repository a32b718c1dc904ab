"""Caverphone, both versions, as lists of rewriting steps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hearsay.native.text import column, first_bytes, rewritten

# Fixed values: (pattern, replacement), in order. 2 and 3 stand for silent letters and vowels.
_LETTERS = (
    ("cq", "2q"), ("ci", "si"), ("ce", "se"), ("cy", "sy"), ("tch", "2ch"), ("[cqx]", "k"), ("v", "f"), ("dg", "2g"),
    ("tio", "sio"), ("tia", "sia"), ("d", "t"), ("ph", "fh"), ("b", "p"), ("sh", "s2"), ("z", "s"),
    ("^[aeiou]", "A"), ("[aeiou]", "3"),
)
_GUTTURALS = (("3gh3", "3kh3"), ("gh", "22"), ("g", "k"))
_RUNS = (("s+", "S"), ("t+", "T"), ("p+", "P"), ("k+", "K"), ("f+", "F"), ("m+", "M"), ("n+", "N"))

FIRST = (
    ("^(cou|rou|tou|enou)gh", "$12f"), ("^gn", "2n"), (r"mb\z", "m2"), *_LETTERS, *_GUTTURALS, *_RUNS,
    ("w3", "W3"), ("wy", "Wy"), ("wh3", "Wh3"), ("why", "Why"), ("w", "2"), ("^h", "A"), ("h", "2"),
    ("r3", "R3"), ("ry", "Ry"), ("r", "2"), ("l3", "L3"), ("ly", "Ly"), ("l", "2"), ("j", "y"), ("y3", "Y3"), ("y", "2"), ("[23]", ""),
)
SECOND = (
    (r"e\z", ""), ("^(cou|rou|tou|enou|trou)gh", "$12f"), ("^gn", "2n"), (r"mb\z", "m2"), *_LETTERS,
    ("j", "y"), ("^y3", "Y3"), ("^y", "A"), ("y", "3"), *_GUTTURALS, *_RUNS,
    ("w3", "W3"), ("wh3", "Wh3"), (r"w\z", "3"), ("w", "2"), ("^h", "A"), ("h", "2"),
    ("r3", "R3"), (r"r\z", "3"), ("r", "2"), ("l3", "L3"), (r"l\z", "3"), ("l", "2"), ("2", ""), (r"3\z", "A"), ("3", ""),
)


def _code(c: Column | str, steps: tuple[tuple[str, str], ...], length: int) -> Column:
    small = F.regexp_replace(F.lower(column(c)), r"[^\p{IsLowercase}]", "")
    return first_bytes(F.concat(rewritten(small, steps), F.lit("1" * length)), length)


def caverphone1(c: Column | str) -> Column:
    """Six bytes, filled with 1; null if a letter beyond ASCII would be cut."""
    return _code(c, FIRST, 6)


def caverphone2(c: Column | str) -> Column:
    """Ten bytes, filled with 1; null if a letter beyond ASCII would be cut."""
    return _code(c, SECOND, 10)
