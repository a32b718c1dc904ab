"""Column functions: every encoder, comparison and option; and their registration for SQL.

Null gives null. Encoders that Catalyst's expressions can say are such expressions; the others run in Arrow
batches and encode each distinct value of a batch once.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from hearsay.kernels import daitch_mokotoff as _dm
from hearsay.kernels import match_rating as _mra
from hearsay.kernels.beider_morse import BeiderMorse, alternatives
from hearsay.kernels.double_metaphone import double_metaphone as _double_metaphone
from hearsay.kernels.metaphone import metaphone as _metaphone
from hearsay.kernels.nysiis import nysiis as _nysiis
from hearsay.kernels.phonex import phonex as _phonex
from hearsay.native.caverphone import caverphone1 as _caverphone1
from hearsay.native.caverphone import caverphone2 as _caverphone2
from hearsay.native.cologne import cologne
from hearsay.native.match_rating import match_rating as _match_rating
from hearsay.native.soundex import ENGLISH, GENEALOGY, REFINED, SIMPLIFIED, agreement, refined_soundex_difference, soundex_difference
from hearsay.native.soundex import refined_soundex as _refined_soundex
from hearsay.native.soundex import soundex as _soundex
from hearsay.native.text import column, trimmed

__all__ = [
    "ENGLISH", "GENEALOGY", "REFINED", "SIMPLIFIED", "Encoder", "agreement", "beider_morse", "beider_morse_alternatives", "beider_morse_languages", "caverphone1", "caverphone2", "cologne",
    "daitch_mokotoff", "daitch_mokotoff_codes", "daitch_mokotoff_soundex", "difference", "double_metaphone", "double_metaphone_equal", "encoded", "encoded_equal", "languages_both", "languages_either",
    "match_rating", "match_rating_equal", "metaphone", "nysiis", "one_language", "phonex", "refined_soundex", "refined_soundex_difference", "register", "register_all", "register_options", "soundex", "soundex_difference",
]


class Encoder(Protocol):
    """Anything with ``encode``, also one of a user's own."""

    def encode(self, word: str) -> str | None: ...


def _batched(function: Callable[[str], object], kind: str, arrow: pa.DataType):
    """An Arrow function that calls ``function`` once for each distinct value of a batch."""

    @F.arrow_udf(kind)
    def run(words: pa.Array) -> pa.Array:
        coded = (words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words).dictionary_encode()
        codes = pa.array([function(w) for w in coded.dictionary.to_pylist()], arrow)
        return codes.take(coded.indices)

    return run


def _with_errors(encode: Callable[..., Column]) -> Callable[..., Column]:
    """on_error: "null" (texts that can't be encoded have no code) or "raise"."""

    @functools.wraps(encode)
    def run(c: Column | str, *options, on_error: str = "null", **more) -> Column:
        if on_error not in ("null", "raise"):
            raise ValueError(f'on_error is "null" or "raise", not {on_error!r}')
        code = encode(c, *options, **more)
        if on_error == "null":
            return code
        return F.when(column(c).isNull(), F.lit(None).cast("string")).otherwise(F.coalesce(code, F.raise_error(F.concat(F.lit(f"{encode.__name__}: no code for "), column(c)))))

    return run


soundex, refined_soundex, caverphone1, caverphone2, match_rating = map(_with_errors, (_soundex, _refined_soundex, _caverphone1, _caverphone2, _match_rating))


def difference(a: Column | str, b: Column | str, encode: Callable[[Column], Column]) -> Column:
    """Places at which the codes of two texts under any encoder agree."""
    x, y = column(a), column(b)
    return F.when(x.isNotNull() & y.isNotNull(), agreement(encode(x), encode(y)))


def encoded(c: Column | str, encoder: Encoder) -> Column:
    """Codes of any encoder object, which must be picklable."""
    return _batched(encoder.encode, "string", pa.string())(column(c))


@_with_errors
def nysiis(c: Column | str, strict: bool = True) -> Column:
    return _batched(lambda w: _nysiis(w, strict), "string", pa.string())(column(c))


def phonex(c: Column | str, max_length: int = 4) -> Column:
    return _batched(lambda w: _phonex(w, max_length), "string", pa.string())(column(c))


def metaphone(c: Column | str, max_length: int | None = 4) -> Column:
    return _batched(lambda w: _metaphone(w, max_length), "string", pa.string())(column(c))


def double_metaphone(c: Column | str, max_length: int | None = 4) -> Column:
    """Struct of primary and alternate."""
    kind = pa.struct([("primary", pa.string()), ("alternate", pa.string())])
    return _batched(lambda w: dict(zip(("primary", "alternate"), _double_metaphone(w, max_length))), "primary string, alternate string", kind)(column(c))


def double_metaphone_equal(a: Column | str, b: Column | str, alternate: bool = False, max_length: int | None = 4) -> Column:
    """Primary codes, or alternate ones, are compared with their like."""
    name = "alternate" if alternate else "primary"
    return double_metaphone(a, max_length)[name] == double_metaphone(b, max_length)[name]


def daitch_mokotoff_codes(c: Column | str, branching: bool = True, rules: _dm.DaitchMokotoff | None = None) -> Column:
    """Array of codes. rules: of one's own, else those of the package, with folding."""
    return _batched(lambda w: (rules or _dm.built_in()).codes(w, branching), "array<string>", pa.list_(pa.string()))(column(c))


def daitch_mokotoff_soundex(c: Column | str, rules: _dm.DaitchMokotoff | None = None) -> Column:
    """All codes, parted by |."""
    return F.array_join(daitch_mokotoff_codes(c, True, rules), "|")


def daitch_mokotoff(c: Column | str, rules: _dm.DaitchMokotoff | None = None) -> Column:
    """The first code, without branching."""
    return daitch_mokotoff_codes(c, False, rules)[0]


def beider_morse(c: Column | str, engine: BeiderMorse, languages=None) -> Column:
    """Codes; languages: a set given from outside, else they are guessed for each name."""
    if languages is None:
        return encoded(c, engine)
    chosen = engine.checked(languages)
    return _batched(lambda w: engine.encode_for(w, chosen), "string", pa.string())(column(c))


def beider_morse_languages(c: Column | str, engine: BeiderMorse) -> Column:
    """Sorted array of the languages a name may be of; null: any."""
    return _batched(lambda w: (found := engine.guess(w)) and sorted(found), "array<string>", pa.list_(pa.string()))(column(c))


def beider_morse_alternatives(c: Column | str, engine: BeiderMorse) -> Column:
    """The parts of a name's code, an array of the alternatives of each."""
    return _batched(lambda w: alternatives(engine.encode(w)), "array<array<string>>", pa.list_(pa.list_(pa.string())))(column(c))


def languages_both(a: Column | str, b: Column | str) -> Column:
    """Languages in both sets, sorted; null: any."""
    x, y = column(a), column(b)
    return F.array_sort(F.when(x.isNull(), y).when(y.isNull(), x).otherwise(F.array_intersect(x, y)))


def languages_either(a: Column | str, b: Column | str) -> Column:
    """Languages in either set, sorted; null: any."""
    return F.array_sort(F.array_union(column(a), column(b)))


def one_language(a: Column | str) -> Column:
    """The language of a set of one; null for other sets and for any."""
    return F.when(F.size(column(a)) == 1, F.get(column(a), F.lit(0)))


def encoded_equal(a: Column | str, b: Column | str, encode: Callable[[Column], Column]) -> Column:
    """Whether two texts have one code under ``encode``; empty codes are equal."""
    return encode(column(a)) == encode(column(b))


def match_rating_equal(a: Column | str, b: Column | str) -> Column:
    """Match Rating comparison: not for blank texts or single bytes; equal texts; else by the codes' rating."""
    x, y = column(a), column(b)

    @F.arrow_udf("boolean")
    def rated(p: pa.Array, q: pa.Array) -> pa.Array:
        seen: dict[tuple, bool] = {}
        pairs = list(zip(p.to_pylist(), q.to_pylist()))
        for pair in pairs:
            if pair not in seen:
                seen[pair] = _mra.codes_match(*pair) if None not in pair else None
        return pa.array([seen[pair] for pair in pairs], pa.bool_())

    return F.when(x.isNull() | y.isNull(), F.lit(None)).when(F.least(F.octet_length(trimmed(x)), F.octet_length(trimmed(y))) < 2, F.lit(False)).when(x == y, F.lit(True)).otherwise(rated(match_rating(x), match_rating(y)))


def register(spark: SparkSession, name: str, encoder: Encoder) -> None:
    """A user's encoder as a SQL function."""
    spark.udf.register(name, _batched(encoder.encode, "string", pa.string()))


def _register_expression(spark: SparkSession, name: str, encode: Callable[[Column], Column]) -> None:
    """A Catalyst expression as a temporary SQL function of one text."""
    plan = spark.sql("SELECT '' AS w").select(encode(F.col("w")))._jdf.queryExecution().analyzed()
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(w STRING) RETURNS STRING RETURN {plan.projectList().head().child().sql()}")


def _register_agreement(spark: SparkSession, name: str, code: str) -> None:
    """Places at which the codes of two texts agree, as a temporary SQL function over that of the code."""
    agree = f"zip_with(split({code}(a), ''), split({code}(b), ''), (x, y) -> coalesce(x = y AND x <> '', false))"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(a STRING, b STRING) RETURNS INT RETURN CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN size(filter({agree}, x -> x)) END")


def register_options(spark: SparkSession, prefix: str = "phonetic_", engine: BeiderMorse | None = None) -> list[str]:
    """Encoders with their options, and comparisons of two texts, as SQL functions; the names. engine: also Beider-Morse under its rules."""

    def of_length(function: Callable[[str, int], str]):
        @F.arrow_udf("string")
        def run(words: pa.Array, lengths: pa.Array) -> pa.Array:
            seen = {(w, n): None if w is None or n is None else function(w, n) for w, n in set(zip(words.to_pylist(), lengths.to_pylist()))}
            return pa.array([seen[x] for x in zip(words.to_pylist(), lengths.to_pylist())], pa.string())

        return run

    udfs = {
        "nysiis_full": _batched(lambda w: _nysiis(w, False), "string", pa.string()),
        "metaphone_of": of_length(_metaphone),
        "phonex_of": of_length(_phonex),
        "double_metaphone_of": of_length(lambda w, n: _double_metaphone(w, n)[0]),
        "double_metaphone_alternate_of": of_length(lambda w, n: _double_metaphone(w, n)[1]),
        "daitch_mokotoff_codes": _batched(lambda w: _dm.built_in().codes(w), "array<string>", pa.list_(pa.string())),
    }
    if engine is not None:
        udfs["beider_morse"] = _batched(engine.encode, "string", pa.string())
        udfs["beider_morse_languages"] = _batched(lambda w: (found := engine.guess(w)) and sorted(found), "array<string>", pa.list_(pa.string()))
    pairs = {"soundex_difference": soundex, "refined_soundex_difference": refined_soundex}
    for name, udf in udfs.items():
        spark.udf.register(prefix + name, udf)
    for name, encode in pairs.items():
        _register_expression(spark, f"{prefix}{encode.__name__}", encode)
        _register_agreement(spark, prefix + name, f"{prefix}{encode.__name__}")
    return [prefix + n for n in (*udfs, *pairs)]


def register_all(spark: SparkSession, prefix: str = "phonetic_") -> list[str]:
    """Every encoder with default options as a SQL function; the names."""
    native = {
        "soundex": soundex,
        "soundex_genealogy": lambda c: soundex(c, GENEALOGY),
        "refined_soundex": refined_soundex,
        "caverphone1": caverphone1,
        "caverphone2": caverphone2,
        "cologne": cologne,
        "match_rating": match_rating,
    }
    batched = {
        "nysiis": _nysiis,
        "phonex": _phonex,
        "metaphone": _metaphone,
        "daitch_mokotoff": lambda w: _dm.built_in().encode(w),
        "daitch_mokotoff_soundex": lambda w: _dm.built_in().soundex(w),
        "double_metaphone": lambda w: _double_metaphone(w)[0],
        "double_metaphone_alternate": lambda w: _double_metaphone(w)[1],
    }
    for name, encode in native.items():
        _register_expression(spark, prefix + name, encode)
    for name, function in batched.items():
        spark.udf.register(prefix + name, _batched(function, "string", pa.string()))
    return [prefix + n for n in (*native, *batched)]
