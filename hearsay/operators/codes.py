"""Codes of columns, grouping by them, and joins on them. Every join is an equi-join; none pairs all rows."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearsay.functions import agreement, match_rating_equal
from hearsay.kernels.match_rating import least_rating
from hearsay.native.match_rating import match_rating
from hearsay.native.soundex import soundex
from hearsay.native.text import trimmed

Encode = Callable[[Column], Column]


def once(expression: Column) -> Column:
    """For ``withColumn``: evaluated once, as no filter on the column moves below a generator."""
    return F.explode(F.array(expression))


def encode_distinct(df: DataFrame, text: str, encode: Encode, code: str = "code") -> DataFrame:
    """``df`` with the code of a column, each distinct value encoded once. For costly encoders over values that repeat."""
    codes = df.select(F.col(text).alias("_value")).where(F.col("_value").isNotNull()).distinct().withColumn(code, encode(F.col("_value")))
    return df.join(codes, F.col(text) == codes["_value"], "left").drop("_value")


def group_by_code(df: DataFrame, text: str, encode: Encode, code: str = "code") -> DataFrame:
    """(code, n_rows, n_values) over all rows. Values are counted before they are encoded."""
    counted = df.groupBy(F.col(text).alias("_value")).agg(F.count("*").alias("n"))
    return counted.groupBy(encode(F.col("_value")).alias(code)).agg(F.sum("n").alias("n_rows"), F.count("_value").alias("n_values"))


def explode_codes(df: DataFrame, codes: Column, code: str = "code") -> DataFrame:
    """A row for each distinct code in an array column."""
    return df.withColumn(code, F.explode(F.array_distinct(codes)))


def code_join(left: DataFrame, right: DataFrame, left_text: str, right_text: str, encode: Encode, how: str = "inner", drop_empty: bool = False) -> DataFrame:
    """Rows of equal codes; drop_empty: an empty code equals none. Catalyst picks the join by the sides' sizes."""

    def code(text: str) -> Column:
        made = encode(F.col(text))
        return once(F.nullif(made, F.lit("")) if drop_empty else made)

    joined = left.withColumn("_left_code", code(left_text)).join(right.withColumn("_right_code", code(right_text)), F.col("_left_code") == F.col("_right_code"), how)
    return joined.drop("_left_code", "_right_code")


#: Values of one code in a unit of an overlap join; codes of more are dealt out.
CODE_BLOCK = 10_000


def overlap_join(left: DataFrame, right: DataFrame, left_text: str, right_text: str, codes: Encode, block: int = CODE_BLOCK) -> DataFrame:
    """Distinct pairs of values (left_value, right_value) that share a code; ``codes`` gives arrays.

    A pair comes out at the least of its shared codes only, so nothing is left to make distinct after the join. Codes of many
    values on the right are dealt out by hash; the left goes to each part.
    """
    x = left.select(F.col(left_text).alias("left_value")).distinct().withColumn("left_codes", once(F.array_distinct(codes(F.col("left_value")))))
    y = right.select(F.col(right_text).alias("right_value")).distinct().withColumn("right_codes", once(F.array_distinct(codes(F.col("right_value")))))
    every = y.withColumn("code", F.explode("right_codes"))
    hot = every.groupBy("code").agg(F.count("*").alias("n")).where(F.col("n") > block).select("code", F.ceil(F.col("n") / block).cast("int").alias("parts"))
    parts = F.coalesce("parts", F.lit(1))
    dealt = every.join(hot, "code", "left").withColumn("part", F.pmod(F.xxhash64("right_value"), parts).cast("int")).drop("parts")
    asking = x.withColumn("code", F.explode("left_codes")).join(hot, "code", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    met = asking.join(dealt, ["code", "part"])
    return met.where(F.col("code") == F.array_min(F.array_intersect("left_codes", "right_codes"))).select("left_value", "right_value")


def _agreements(longer: int, shorter: int) -> int:
    """Characters that must cancel for codes of these lengths to match: the longer less those leaves six less the least rating."""
    return max(0, longer - 6 + least_rating(longer + shorter))


def _rating_sets(right: bool) -> list[tuple[int, str, list[int]]]:
    """(length, name, places) of all sets of places at which codes of two lengths must agree for a match, some hundreds; names begin with the left code's length."""
    out = []
    for n in range(1, 7):
        for m in range(max(1, n - 2), min(6, n + 2) + 1):
            long, short = max(n, m), min(n, m)
            # from the left and, where the lengths differ, from the right
            places = [*range(1, short + 1), *(range(-short, 0) if n != m else ())]
            lengths = f"{m}.{n}" if right else f"{n}.{m}"
            out += [(n, f"{lengths}:{','.join(map(str, chosen))}:", list(chosen)) for chosen in combinations(places, _agreements(long, short))]
    return out


def match_rating_candidates(left: DataFrame, right: DataFrame) -> DataFrame:
    """left (left_code), right (right_code): distinct pairs that may match.

    For each length the other code may have, the characters of codes of up to six ASCII characters cancel at some set of so
    many places, counted from either end, as the lengths ask for; every such set with its characters is a key. Codes
    with characters beyond ASCII meet all that share a character at a place.
    """
    def plain(name: str) -> Column:
        return (F.octet_length(name) == F.length(name)) & (F.length(name) < 7)

    def by_sets(codes: DataFrame, name: str) -> DataFrame:
        sets = F.broadcast(codes.sparkSession.createDataFrame(_rating_sets(name == "right_code"), "size int, name string, places array<int>"))
        signs = F.transform("places", lambda p: F.substr(F.col(name), p, F.lit(1)))
        return codes.where(plain(name)).join(sets, F.length(name) == F.col("size")).select(name, F.concat("name", F.array_join(signs, "")).alias("key"))

    def by_places(codes: DataFrame, name: str) -> DataFrame:
        code = F.col(name)
        here = F.transform(F.sequence(F.lit(1), F.length(code)), lambda p: F.array(F.concat(F.lit("L"), p, F.substr(code, p, F.lit(1))), F.concat(F.lit("R"), p, F.substr(code, -p, F.lit(1)))))
        short = F.when(F.octet_length(code) < 5, F.array(F.lit("short"))).otherwise(F.array().cast("array<string>"))
        return codes.select(name, F.explode(F.concat(F.flatten(here), short)).alias("key"))

    x, y = left.select("left_code").where("left_code <> ''").distinct(), right.select("right_code").where("right_code <> ''").distinct()
    odd_x, odd_y = x.where(~plain("left_code")), y.where(~plain("right_code"))
    met = [(by_sets(x, "left_code"), by_sets(y, "right_code")), (by_places(odd_x, "left_code"), by_places(y, "right_code")), (by_places(x.where(plain("left_code")), "left_code"), by_places(odd_y, "right_code"))]
    pairs = [a.join(b, "key").select("left_code", "right_code") for a, b in met]
    return pairs[0].union(pairs[1]).union(pairs[2]).where(F.abs(F.octet_length("left_code") - F.octet_length("right_code")) < 3).distinct()


def match_rating_join(left: DataFrame, right: DataFrame, left_text: str, right_text: str) -> DataFrame:
    """Distinct pairs of values that the Match Rating comparison takes for the same.

    Codes that match have as many equal characters at the same places, from the left or from the right, as their
    lengths ask for; they are joined on those places and characters, which loses no pair.
    """
    a = left.select(F.col(left_text).alias("left_value")).where("left_value is not null").distinct()
    b = right.select(F.col(right_text).alias("right_value")).where("right_value is not null").distinct()
    x, y = a.withColumn("left_code", once(match_rating(F.col("left_value")))), b.withColumn("right_code", once(match_rating(F.col("right_value"))))
    near = match_rating_candidates(x, y)
    paired = x.join(near, "left_code").join(y, "right_code").where(match_rating_equal("left_value", "right_value")).select("left_value", "right_value")
    same = a.join(b, F.col("left_value") == F.col("right_value")).where(F.octet_length(trimmed(F.col("left_value"))) > 1)
    return paired.union(same).distinct()


def difference_join(left: DataFrame, right: DataFrame, left_text: str, right_text: str, least: int, encode: Encode = soundex) -> DataFrame:
    """Distinct pairs of values whose Soundex codes agree at ``least`` of the four places or more: (left_value, right_value, difference).

    Such codes are equal at some set of ``least`` places, so they are joined on those sets.
    """
    if not 1 <= least <= 4:
        raise ValueError("least is from 1 to 4: at 0 every pair would match")
    a = left.select(F.col(left_text).alias("left_value")).distinct().withColumn("left_code", once(encode(F.col("left_value"))))
    b = right.select(F.col(right_text).alias("right_value")).distinct().withColumn("right_code", once(encode(F.col("right_value"))))

    def keys(codes: DataFrame, name: str) -> DataFrame:
        sets = [F.concat(*(F.concat(F.lit(str(p)), F.substring(name, p, 1)) for p in places)) for places in combinations((1, 2, 3, 4), least)]
        return codes.select(name).where(F.length(name) == 4).distinct().select(name, F.explode(F.array(*sets)).alias("key"))

    near = keys(a, "left_code").join(keys(b, "right_code"), "key").select("left_code", "right_code").distinct().withColumn("difference", agreement(F.col("left_code"), F.col("right_code")))
    return a.join(near, "left_code").join(b, "right_code").select("left_value", "right_value", "difference")
