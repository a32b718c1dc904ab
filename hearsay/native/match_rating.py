"""Match Rating codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hearsay.native.text import BLANKS, column, first_bytes, trimmed

# Accented letters and what they become.
ACCENTED = "ÀàÈèÌìÒòÙùÁáÉéÍíÓóÚúÝýÂâÊêÎîÔôÛûŶŷÃãÕõÑñÄäËëÏïÖöÜüŸÿÅåÇçŐőŰű"
PLAIN = "AaEeIiOoUuAaEeIiOoUuYyAaEeIiOoUuYyAaOoNnAaEeIiOoUuYyAaCcOoUu"
CONSONANTS = "BCDFGHJKLMNPQRSTVWXYZ"
DROPPED = "-&'.,"


def match_rating(c: Column | str) -> Column:
    """At most six bytes; empty for texts of less than two bytes; null if a letter beyond ASCII would be cut."""
    name = column(c)
    kept = F.translate(F.regexp_replace(F.upper(name), f"[{DROPPED}{BLANKS}]", ""), ACCENTED, PLAIN)
    said = F.upper(F.concat(F.substring(kept, 1, 1), F.regexp_replace(F.substring(kept, 2, 2**30), "[AEIOUaeiou]", "")))
    for x in CONSONANTS:
        said = F.replace(said, F.lit(x * 2), F.lit(x))
    return F.when(F.octet_length(trimmed(name)) < 2, F.lit("")).when(F.octet_length(said) > 6, first_bytes(said, 3, 3)).otherwise(said)
