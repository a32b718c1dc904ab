"""Soundex with any mapping, Refined Soundex, and how many characters of two codes agree."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hearsay.native.text import LETTERS, cleaned, collapsed, column, mapping

# Codes of the letters A to Z; - is silent.
ENGLISH = "01230120022455012623010202"
GENEALOGY = "-123-12--22455-12623-1-2-2"
SIMPLIFIED = ENGLISH
REFINED = "01360240043788015936020505"
SILENT = "-"
LENGTH = 4


def soundex(c: Column | str, codes: str = ENGLISH, special_h_w: bool | None = None) -> Column:
    """Letter and three codes.

    codes: of the 26 letters. special_h_w: whether H and W between equal codes hide the second; None: if no
    letter is silent. Null and empty stay so. A letter beyond A to Z that the code needs gives null.
    """
    codes = mapping(codes)
    hidden = SILENT not in codes if special_h_w is None else special_h_w
    # one chain of expressions: a condition on an intermediate would evaluate it again
    word = F.regexp_replace(cleaned(column(c)), "[^A-Z].*", _FOREIGN)
    dropped = "".join(x for x, code in zip(LETTERS, codes) if code == SILENT or hidden and x in "HW")
    said = F.regexp_replace(word, f"(?<=.)[{dropped}]", "") if dropped else word
    run = collapsed(F.translate(said, LETTERS, codes))
    digits = F.translate(F.substring(run, 2, 2**30), "0", "")
    filled = F.concat(F.substring(word, 1, 1), F.substring(digits, 1, LENGTH - 1), F.lit("0" * (LENGTH - 1)))
    return _unless_foreign(F.regexp_replace(filled, f"^0+$|(?<=^.{{{LENGTH}}}).*", ""))


#: Stands for a letter beyond A to Z.
_FOREIGN = "\x01"


def _unless_foreign(code: Column) -> Column:
    return F.nullif(F.regexp_replace(code, f"^.*{_FOREIGN}.*$", _FOREIGN), F.lit(_FOREIGN))


def refined_soundex(c: Column | str, codes: str = REFINED) -> Column:
    """First letter, then the codes of all letters, runs as one. A letter beyond A to Z gives null."""
    word = F.regexp_replace(cleaned(column(c)), "[^A-Z]", _FOREIGN)
    return _unless_foreign(F.concat(F.substring(word, 1, 1), collapsed(F.translate(word, LETTERS, mapping(codes)))))


def agreement(a: Column, b: Column) -> Column:
    """Positions at which two codes have the same character; 0 if one is empty."""
    signs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.coalesce((x == y) & (x != ""), F.lit(False)))
    return F.size(F.filter(signs, lambda x: x)).cast("int")


def soundex_difference(a: Column | str, b: Column | str, codes: str = ENGLISH, special_h_w: bool | None = None) -> Column:
    return F.when(column(a).isNotNull() & column(b).isNotNull(), agreement(soundex(a, codes, special_h_w), soundex(b, codes, special_h_w)))


def refined_soundex_difference(a: Column | str, b: Column | str, codes: str = REFINED) -> Column:
    return F.when(column(a).isNotNull() & column(b).isNotNull(), agreement(refined_soundex(a, codes), refined_soundex(b, codes)))
