"""Cologne phonetics.

Letters whose code depends on their neighbours are replaced first, in an order that keeps what later steps look
at; lower-case letters stand for codes until the neighbours are no longer needed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hearsay.native.text import collapsed, column, rewritten

# Fixed values: (pattern, replacement), in order. Between letters a - may stand for what is no letter.
STEPS = (
    ("[DT](?![CSZ])", "t"),
    ("[DT]", "z"),
    ("P(?!H)", "b"),
    # the first letter that has a code; H has none
    ("^([-H]*)C(?=[AHKLOQRUX])", "$1k"),
    ("^([-H]*)C", "$1s"),
    ("(?<=[SZ]|[SZ]-)C", "s"),
    ("C(?![AHKOQUX])", "s"),
    ("C", "k"),
    # k and s are what became of C
    ("(?<=[ksKQ]|[ksKQ]-)X", "z"),
    ("X", "Gz"),
    ("[AEIJOUY]", "0"),
    ("[bB]", "1"),
    ("t", "2"),
    ("[FPVW]", "3"),
    ("[kGKQ]", "4"),
    ("L", "5"),
    ("[MN]", "6"),
    ("R", "7"),
    ("[szSZ]", "8"),
    ("-", ""),
)


def cologne(c: Column | str) -> Column:
    """Digits, of any number; equal neighbours once, and 0 only in front."""
    plain = F.translate(F.upper(column(c)), "ÄÜÖ", "AUO")
    codes = collapsed(rewritten(F.regexp_replace(plain, "[^A-Z]+", "-"), STEPS))
    told = F.translate(codes, "H", "")
    return F.concat(F.substring(told, 1, 1), F.translate(F.substring(told, 2, 2**30), "0", ""))
