"""Expressions that several encoders share."""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Unicode White_Space, as the inside of a character class for Java's and Python's expressions.
BLANKS = "\t-\r \u0085   -     　"


@lru_cache(1)
def blanks() -> str:
    """All blank characters."""
    return "".join(c for c in map(chr, range(0x3001)) if re.match(f"[{BLANKS}]", c))


def column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rewritten(text: Column, steps: tuple[tuple[str, str], ...]) -> Column:
    """Patterns replaced one after another; those of plain characters without a regular expression."""
    for pattern, replacement in steps:
        plain = pattern.isalnum() and replacement.isalnum()
        text = F.replace(text, F.lit(pattern), F.lit(replacement)) if plain else F.regexp_replace(text, pattern, replacement)
    return text


def cleaned(text: Column) -> Column:
    """Letters only, in upper case."""
    return F.upper(F.regexp_replace(text, r"[^\p{IsAlphabetic}]", ""))


def collapsed(text: Column) -> Column:
    """Runs of a character as one."""
    return F.regexp_replace(text, r"(.)\1+", "$1")


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{BLANKS}]+|[{BLANKS}]+\\z", "")


def first_bytes(text: Column, n: int, last: int = 0) -> Column:
    """The first n and the last so many bytes of UTF-8; null if a character would be cut."""
    data = text.cast("binary")
    head = F.substring(data, 1, n).cast("string")
    # either part is valid alone, or a character was cut
    parts = [head, F.substring(data, -last, last).cast("string")] if last else [head]
    return F.concat(*map(F.try_validate_utf8, parts))


def mapping(codes) -> str:
    """26 codes, one for each letter, checked."""
    codes = "".join(codes)
    if len(codes) != len(LETTERS):
        raise ValueError(f"a mapping has a code for each of 26 letters, not {len(codes)}")
    return codes
