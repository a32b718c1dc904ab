"""Registered queries over the driver's tables and their DuckDB equivalents.

Words are counted before they are encoded: the encoders see each distinct word of a table once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearsay import functions as H
from hearsay.kernels.beider_morse import BeiderMorse, NameType, RuleSet, RuleType
from hearsay.kernels.daitch_mokotoff import DaitchMokotoff, built_in_text
from hearsay.native import caverphone, match_rating
from hearsay.operators import codes as ops
from hearsay.plans import oracles, small_rules


def part_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of every part name."""
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.explode(F.split("p_name", " ")).alias("word"))


def _spread(df: DataFrame) -> DataFrame:
    """Over all cores where the files have fewer splits than there are cores; large inputs aren't moved."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def document_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(word, n): runs of ASCII letters in all documents, in upper case, with their number."""
    texts = _spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text")).select(F.explode(F.split("text", "[^A-Za-z]+")).alias("word"))
    return texts.where("word <> ''").groupBy(F.upper("word").alias("word")).agg(F.count("*").alias("n"))


def _by_code(encode):
    """Number of words and of distinct words by their code, over all documents."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        coded = document_words(spark, sf_dir).select(encode(F.col("word")).alias("code"), "n")
        return coded.groupBy("code").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_words"))

    return query


def soundex_part_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of part names grouped by their Soundex code."""
    return ops.group_by_code(part_words(spark, sf_dir), "word", H.soundex).select("code", F.col("n_rows").alias("n_words"))


def soundex_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct part words under each Soundex mapping."""
    words = part_words(spark, sf_dir).distinct()
    return words.select("word", H.soundex("word").alias("american"), H.soundex("word", H.GENEALOGY).alias("genealogy"), H.soundex("word", H.SIMPLIFIED, False).alias("simplified"))


def soundex_difference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part words and market segments whose Soundex codes agree at two places or more."""
    segments = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_mktsegment")
    return ops.difference_join(part_words(spark, sf_dir), segments, "word", "c_mktsegment", 2)


def refined_difference_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many places of the Refined Soundex codes of a part word and its name's last word agree."""
    names = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.split("p_name", " ").alias("w")).distinct()
    return names.select(F.col("w")[0].alias("first_word"), F.element_at("w", -1).alias("last_word")).withColumn("difference", H.refined_soundex_difference("first_word", "last_word"))


def phonetic_join_soundex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct part words with the words of documents of the same Soundex code."""
    words = part_words(spark, sf_dir).distinct()
    return ops.code_join(words, document_words(spark, sf_dir).withColumnRenamed("word", "document_word"), "word", "document_word", H.soundex).select("word", "document_word", "n")


def double_metaphone_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents by primary and alternate code."""
    coded = document_words(spark, sf_dir).withColumn("codes", H.double_metaphone("word").alias("codes"))
    return coded.groupBy("codes.primary", "codes.alternate").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_words"))


def dm_alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents by each of their Daitch-Mokotoff codes."""
    coded = document_words(spark, sf_dir).withColumn("codes", H.daitch_mokotoff_codes("word"))
    return ops.explode_codes(coded, F.col("codes")).groupBy("code").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_words"))


def dm_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part words and words of documents that share a Daitch-Mokotoff code."""
    return ops.overlap_join(part_words(spark, sf_dir), document_words(spark, sf_dir), "word", "word", H.daitch_mokotoff_codes)


def mra_match_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part words and market segments that match by rating."""
    segments = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_mktsegment")
    return ops.match_rating_join(part_words(spark, sf_dir), segments, "word", "c_mktsegment")


def accented_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of the words of documents that have a letter beyond ASCII, by the encoders that fold or know such letters."""
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.explode(F.split("text", f"[^{ACCENTED_LETTERS}]+")).alias("word"))
    words = texts.where(F.col("word").rlike("[^A-Za-z]")).groupBy("word").agg(F.count("*").alias("n"))
    all_codes = F.array_join(F.array_sort(F.array_distinct(H.daitch_mokotoff_codes("word"))), "|")
    return words.select("word", "n", H.cologne("word").alias("cologne"), H.match_rating("word").alias("match_rating"), all_codes.alias("daitch_mokotoff"))


def dm_own_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents by the first code under a few rules of one's own, without folding."""
    own = DaitchMokotoff.parse(small_rules.DAITCH_MOKOTOFF, ascii_folding=False)
    coded = document_words(spark, sf_dir).select(H.daitch_mokotoff("word", own).alias("code"), "n")
    return coded.groupBy("code").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_words"))


def double_metaphone_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part words and words of documents of one Soundex code, and whether their primary and their alternate codes are the same."""
    pairs = phonetic_join_soundex(spark, sf_dir).select("word", F.col("document_word").alias("other"))
    return pairs.select("word", "other", H.double_metaphone_equal("word", "other").alias("same"), H.double_metaphone_equal("word", "other", alternate=True).alias("same_alternate"))


def _engine(**more) -> BeiderMorse:
    return BeiderMorse(RuleSet.parse(small_rules.ALL_TYPES), **more)


def bm_document_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents by their exact code under each name type's small rules, of BM_PHONEMES phonemes at most."""
    words = document_words(spark, sf_dir)
    made = [F.struct(F.lit(kind.value).alias("name_type"), H.beider_morse("word", _engine(name_type=kind, rule_type=RuleType.EXACT, max_phonemes=BM_PHONEMES)).alias("code")) for kind in NameType]
    coded = words.select("n", F.explode(F.array(*made)).alias("c"))
    return coded.groupBy("c.name_type", "c.code").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_words"))


def bm_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part words under the small rules of this package, by guessed and given languages, approximate and exact."""
    words, approx, exact = part_words(spark, sf_dir).distinct(), _engine(), _engine(rule_type=RuleType.EXACT, name_type=NameType.GENERIC, max_phonemes=10)
    return words.select("word", H.beider_morse("word", approx).alias("approx"), H.beider_morse("word", exact).alias("exact"), H.beider_morse("word", exact, ["german"]).alias("german"))


def bm_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages that part words may be of."""
    return part_words(spark, sf_dir).distinct().select("word", F.array_join(H.beider_morse_languages("word", _engine()), "+").alias("languages"))


#: Letters of the words that ``accented_words`` takes.
ACCENTED_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
#: Phonemes that are kept of a word in ``bm_document_words``.
BM_PHONEMES = 4


def _by_strict(c: Column) -> Column:
    return H.nysiis(c)


QUERIES = {
    "soundex_part_words": soundex_part_words,
    "soundex_variants": soundex_variants,
    "soundex_words": _by_code(H.soundex),
    "refined_soundex_words": _by_code(H.refined_soundex),
    "caverphone1_words": _by_code(H.caverphone1),
    "caverphone2_words": _by_code(H.caverphone2),
    "cologne_words": _by_code(H.cologne),
    "mra_encode_words": _by_code(H.match_rating),
    "nysiis_words": _by_code(_by_strict),
    "nysiis_full_words": _by_code(lambda c: H.nysiis(c, strict=False)),
    "phonex_words": _by_code(H.phonex),
    "metaphone_words": _by_code(H.metaphone),
    "double_metaphone_words": double_metaphone_words,
    "dm_words": _by_code(H.daitch_mokotoff),
    "dm_alternatives": dm_alternatives,
    "soundex_difference_pairs": soundex_difference_pairs,
    "refined_difference_words": refined_difference_words,
    "phonetic_join_soundex": phonetic_join_soundex,
    "dm_overlap_join": dm_overlap_join,
    "mra_match_pairs": mra_match_pairs,
    "bm_words": bm_words,
    "bm_languages": bm_languages,
    "bm_document_words": bm_document_words,
    "accented_words": accented_words,
    "dm_own_rules": dm_own_rules,
    "double_metaphone_equality": double_metaphone_equality,
}

# DuckDB has no back-references in patterns, so runs of each code are collapsed one after another.
_WORDS = """w AS (SELECT upper(x) AS word, count(*) AS n FROM (SELECT unnest(string_split_regex(text, '[^A-Za-z]+')) AS x FROM documents) WHERE x <> '' GROUP BY 1)"""
_PARTS = """p AS (SELECT unnest(string_split(p_name, ' ')) AS word FROM part)"""
_ABC = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _runs(sql: str, signs: str = "0123456789") -> str:
    for s in signs:
        sql = f"regexp_replace({sql}, '{s}+', '{s}', 'g')"
    return sql


def _steps(sql: str, steps) -> str:
    for pattern, to in steps:
        sql = f"regexp_replace({sql}, '{pattern}', '{to.replace('$1', chr(92) + '1')}', 'g')"
    return sql


def _soundex_sql(word: str, codes: str = H.ENGLISH, hidden: str = "HW") -> str:
    word = f"upper({word})"
    coded = "".join(c for c in codes if c != "-")
    spoken = "".join(x for x, c in zip(_ABC, codes) if c != "-")
    dropped = hidden + "".join(x for x, c in zip(_ABC, codes) if c == "-")
    head = f"translate(substr({word}, 1, 1), '{_ABC}', '{codes}')"
    tail = f"translate(regexp_replace(substr({word}, 2), '[{dropped or '#'}]', '', 'g'), '{spoken}', '{coded}')"
    digits = f"replace(substr({_runs(f'{head} || {tail}')}, 2), '0', '')"
    return f"rpad(substr({word}, 1, 1) || substr({digits}, 1, 3), 4, '0')"


def _refined_sql(word: str) -> str:
    coded = f"translate(upper({word}), '{_ABC}', '{H.REFINED}')"
    return f"substr(upper({word}), 1, 1) || {_runs(coded)}"


def _caverphone_sql(steps, length: int) -> str:
    return f"substr({_steps('lower(word)', steps)} || '{'1' * length}', 1, {length})"


def _mra_sql(name: str, folded: str | None = None) -> str:
    """name: as it is written; folded: without accents."""
    word = folded or name
    said = f"substr(upper({word}), 1, 1) || regexp_replace(substr(upper({word}), 2), '[AEIOU]', '', 'g')"
    for x in match_rating.CONSONANTS:
        said = f"replace({said}, '{x}{x}', '{x}')"
    return f"CASE WHEN strlen({name}) < 2 THEN '' WHEN length({said}) > 6 THEN left({said}, 3) || right({said}, 3) ELSE {said} END"


def _cologne_sql(word: str) -> str:
    """Tables s, t and u (word, n, d) over w (word, n): letter by letter, with the last letter before and the character after; - is no letter."""
    return f"""c AS (SELECT word, n, regexp_replace({word}, '[^A-Z]+', '-', 'g') AS x FROM w),
s AS (SELECT word, n, list_transform(generate_series(1, length(x)), lambda i: {{'c': substr(x, i, 1), 'b': right(replace(left(x, i - 1), '-', ''), 1), 'a': substr(x, i + 1, 1), 'new': regexp_full_match(left(x, i - 1), '[-H]*')}}) AS l FROM c),
t AS (SELECT word, n, array_to_string(list_transform(l, lambda x: CASE
  WHEN x.c IN ('A','E','I','J','O','U','Y') THEN '0' WHEN x.c = 'B' OR x.c = 'P' AND x.a <> 'H' THEN '1' WHEN x.c IN ('D','T') AND x.a NOT IN ('C','S','Z') THEN '2'
  WHEN x.c IN ('F','P','V','W') THEN '3' WHEN x.c IN ('G','K','Q') THEN '4' WHEN x.c = 'X' AND x.b NOT IN ('C','K','Q') THEN '48' WHEN x.c IN ('S','Z') THEN '8'
  WHEN x.c = 'C' AND x.new THEN CASE WHEN x.a IN ('A','H','K','L','O','Q','R','U','X') THEN '4' ELSE '8' END
  WHEN x.c = 'C' THEN CASE WHEN x.b IN ('S','Z') OR x.a NOT IN ('A','H','K','O','Q','U','X') THEN '8' ELSE '4' END
  WHEN x.c IN ('D','T','X') THEN '8' WHEN x.c = 'R' THEN '7' WHEN x.c = 'L' THEN '5' WHEN x.c IN ('M','N') THEN '6' WHEN x.c = '-' THEN '' ELSE '-' END), '') AS d FROM s),
u AS (SELECT word, n, replace({_runs('d', '012345678')}, '-', '') AS d FROM t)"""


_COLOGNE = f"WITH {_WORDS}, {_cologne_sql('word')} SELECT left(d, 1) || replace(substr(d, 2), '0', '') AS code, CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_words FROM u GROUP BY 1"


# Letter by letter; the two letters after D in DG and a front vowel are skipped.
_METAPHONE = f"""
WITH {_WORDS},
l AS (SELECT word, n, CASE WHEN regexp_matches(word, '^([KGP]N|AE|WR)') THEN substr(word, 2) WHEN word LIKE 'WH%' THEN 'W' || substr(word, 3) WHEN word LIKE 'X%' THEN 'S' || substr(word, 2) ELSE word END AS w FROM w),
s AS (SELECT word, n, list_transform(generate_series(1, length(w)), lambda i: {{'i': i, 'c': substr(w, i, 1), 'b': CASE WHEN i > 1 THEN substr(w, i - 1, 1) ELSE '' END, 'a': substr(w, i + 1, 1), 'r': substr(w, i),
  'skip': i > 1 AND regexp_matches(substr(w, i - 1, 3), '^DG[EIY]$') OR i > 2 AND regexp_matches(substr(w, i - 2, 3), '^DG[EIY]$'), 'four': length(w) > 3}}) AS l FROM l),
t AS (SELECT n, word, array_to_string(list_transform(l, lambda x: CASE
  WHEN x.skip OR x.b = x.c AND x.c <> 'C' THEN '' WHEN x.c IN ('A','E','I','O','U') THEN CASE WHEN x.i = 1 THEN x.c ELSE '' END
  WHEN x.c = 'B' THEN CASE WHEN x.b = 'M' AND x.a = '' THEN '' ELSE 'B' END
  WHEN x.c = 'C' THEN CASE WHEN x.b = 'S' AND x.a IN ('E','I','Y') THEN '' WHEN x.r LIKE 'CIA%' THEN 'X' WHEN x.a IN ('E','I','Y') THEN 'S' WHEN x.b = 'S' AND x.a = 'H' THEN 'K'
    WHEN x.a = 'H' THEN CASE WHEN x.i = 1 AND x.four AND substr(x.r, 3, 1) IN ('A','E','I','O','U') THEN 'K' ELSE 'X' END ELSE 'K' END
  WHEN x.c = 'D' THEN CASE WHEN regexp_matches(x.r, '^DG[EIY]') THEN 'J' ELSE 'T' END
  WHEN x.c = 'G' THEN CASE WHEN x.r = 'GH' OR regexp_matches(x.r, '^GH[^AEIOU]') OR x.i > 1 AND x.a = 'N' THEN '' WHEN x.b <> 'G' AND x.a IN ('E','I','Y') THEN 'J' ELSE 'K' END
  WHEN x.c = 'H' THEN CASE WHEN x.a = '' OR x.b IN ('C','S','P','T','G') THEN '' WHEN x.a IN ('A','E','I','O','U') THEN 'H' ELSE '' END
  WHEN x.c IN ('F','J','L','M','N','R') THEN x.c WHEN x.c = 'K' THEN CASE WHEN x.b = 'C' THEN '' ELSE 'K' END
  WHEN x.c = 'P' THEN CASE WHEN x.a = 'H' THEN 'F' ELSE 'P' END WHEN x.c = 'Q' THEN 'K' WHEN x.c = 'S' THEN CASE WHEN regexp_matches(x.r, '^S(H|IO|IA)') THEN 'X' ELSE 'S' END
  WHEN x.c = 'T' THEN CASE WHEN regexp_matches(x.r, '^TI[AO]') THEN 'X' WHEN x.r LIKE 'TCH%' THEN '' WHEN x.a = 'H' THEN '0' ELSE 'T' END
  WHEN x.c = 'V' THEN 'F' WHEN x.c IN ('W','Y') THEN CASE WHEN x.a IN ('A','E','I','O','U') THEN x.c ELSE '' END WHEN x.c = 'X' THEN 'KS' WHEN x.c = 'Z' THEN 'S' ELSE '' END), '') AS d FROM s)
SELECT CASE WHEN length(word) = 1 THEN word ELSE left(d, 4) END AS code, CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_words FROM t GROUP BY 1
"""

# The rest of the word as it is rewritten, with the letter before it and the code so far.
_NYSIIS = """
WITH RECURSIVE {words},
a AS (SELECT word, n, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(word, '^MAC', 'MCC'), '^KN', 'NN'), '^K', 'C'), '^P[HF]', 'FF'), '^SCH', 'SSS') AS x FROM w),
b AS (SELECT word, n, regexp_replace(regexp_replace(x, '(EE|IE)$', 'Y'), '(DT|RT|RD|NT|ND)$', 'D') AS x FROM a),
r AS (SELECT word, n, left(x, 1) AS code, left(x, 1) AS p, substr(x, 2) AS rest FROM b
      UNION ALL
      SELECT word, n, CASE WHEN left(t, 1) <> p THEN code || left(t, 1) ELSE code END, left(t, 1), substr(t, 2) FROM (SELECT *, CASE
        WHEN rest LIKE 'EV%' THEN 'AF' || substr(rest, 3) WHEN regexp_matches(rest, '^[AEIOU]') THEN 'A' || substr(rest, 2) WHEN rest LIKE 'Q%' THEN 'G' || substr(rest, 2) WHEN rest LIKE 'Z%' THEN 'S' || substr(rest, 2)
        WHEN rest LIKE 'M%' THEN 'N' || substr(rest, 2) WHEN rest LIKE 'KN%' THEN 'NN' || substr(rest, 3) WHEN rest LIKE 'K%' THEN 'C' || substr(rest, 2) WHEN rest LIKE 'SCH%' THEN 'SSS' || substr(rest, 4)
        WHEN rest LIKE 'PH%' THEN 'FF' || substr(rest, 3) WHEN rest LIKE 'H%' AND (NOT regexp_matches(p, '[AEIOU]') OR NOT regexp_matches(rest, '^H[AEIOU]')) OR rest LIKE 'W%' AND regexp_matches(p, '[AEIOU]') THEN p || substr(rest, 2)
        ELSE rest END AS t FROM r WHERE rest <> '')),
d AS (SELECT n, CASE WHEN length(code) < 2 THEN code ELSE regexp_replace(regexp_replace(regexp_replace(code, 'S$', ''), '(.)AY$', '\\1Y'), 'A$', '') END AS code FROM r WHERE rest = '')
SELECT {cut} AS code, CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_words FROM d GROUP BY 1
"""

# Letters without a code of their own in lower case, M and N with a silent neighbour as one; then sign by sign.
_PHONEX = f"""
WITH RECURSIVE {_WORDS},
a AS (SELECT word, n, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(word, 'S+$', ''), '^KN', 'NN'), '^PH', 'FH'), '^WR', 'RR'), '^H', '') AS x FROM w),
b AS (SELECT word, n, translate(left(x, 1), 'EIOUYPVKQJZ', 'AAAAABFCCGS') || substr(x, 2) AS x FROM a),
c AS (SELECT word, n, left(x, 1) AS first, array_to_string(list_transform(generate_series(1, length(x)), lambda i: CASE
        WHEN substr(x, i, 1) IN ('L','R') AND regexp_matches(substr(x, i + 1, 1), '[^AEIOUY]') OR substr(x, i, 1) IN ('D','T') AND substr(x, i + 1, 1) = 'C' THEN lower(substr(x, i, 1)) ELSE substr(x, i, 1) END), '') AS y FROM b),
e AS (SELECT word, n, first, length(regexp_extract(y, '^[MN][DGd]')) > 0 AS two, translate(regexp_replace(y, '[MN][DGd]', '5', 'g'), 'BPFVCSKGJQXZDTLMNRAEIOUYHWdtlr', '111122222222334556000000' || '00xxxx') AS z FROM c),
r AS (SELECT word, n, z, 1 AS i, first || CASE WHEN two THEN '5' ELSE '' END AS code, CASE WHEN two THEN '5' WHEN left(z, 1) IN ('x', '') THEN '0' ELSE left(z, 1) END AS now, CASE WHEN two THEN '5' WHEN left(z, 1) IN ('x', '') THEN '0' ELSE left(z, 1) END AS last FROM e
      UNION ALL
      SELECT word, n, z, i + 1, CASE WHEN k <> '0' AND k <> last THEN code || k ELSE code END, k, right(CASE WHEN k <> '0' AND k <> last THEN code || k ELSE code END, 1)
      FROM (SELECT *, CASE WHEN substr(z, i + 1, 1) = 'x' THEN now ELSE substr(z, i + 1, 1) END AS k FROM r WHERE i < length(z) AND length(code) < 4)),
f AS (SELECT word, any_value(n) AS n, rpad(max_by(code, i), 4, '0') AS code FROM r GROUP BY word)
SELECT code, CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_words FROM f GROUP BY 1
"""


def _by_code_sql(code: str) -> str:
    return f"WITH {_WORDS} SELECT {code} AS code, CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_words FROM w GROUP BY 1"


_AGREE = "CAST(len(list_filter(generate_series(1, least(length({a}), length({b}))), lambda i: substr({a}, i, 1) = substr({b}, i, 1))) AS INTEGER)"

ORACLES = {
    "soundex_part_words": f"WITH {_PARTS} SELECT {_soundex_sql('word')} AS code, count(*) AS n_words FROM p GROUP BY 1",
    "soundex_variants": f"WITH {_PARTS} SELECT DISTINCT word, {_soundex_sql('word')} AS american, {_soundex_sql('word', H.GENEALOGY, '')} AS genealogy, {_soundex_sql('word', H.SIMPLIFIED, '')} AS simplified FROM p",
    "soundex_words": _by_code_sql(_soundex_sql("word")),
    "refined_soundex_words": _by_code_sql(_refined_sql("word")),
    "caverphone1_words": _by_code_sql(_caverphone_sql(caverphone.FIRST, 6)),
    "caverphone2_words": _by_code_sql(_caverphone_sql(caverphone.SECOND, 10)),
    "cologne_words": _COLOGNE,
    "mra_encode_words": _by_code_sql(_mra_sql("word")),
    "metaphone_words": _METAPHONE,
    "nysiis_words": _NYSIIS.format(words=_WORDS, cut="left(code, 6)"),
    "nysiis_full_words": _NYSIIS.format(words=_WORDS, cut="code"),
    "phonex_words": _PHONEX,
    "soundex_difference_pairs": f"""WITH {_PARTS}, a AS (SELECT DISTINCT word AS left_value, {_soundex_sql('word')} AS x FROM p), b AS (SELECT DISTINCT c_mktsegment AS right_value, {_soundex_sql('c_mktsegment')} AS y FROM customer)
        SELECT left_value, right_value, {_AGREE.format(a='x', b='y')} AS difference FROM a, b WHERE {_AGREE.format(a='x', b='y')} >= 2""",
    "refined_difference_words": f"""WITH q AS (SELECT DISTINCT string_split(p_name, ' ') AS w FROM part), r AS (SELECT w[1] AS first_word, w[-1] AS last_word, {_refined_sql('w[1]')} AS x, {_refined_sql('w[-1]')} AS y FROM q)
        SELECT first_word, last_word, {_AGREE.format(a='x', b='y')} AS difference FROM r""",
    "phonetic_join_soundex": f"""WITH {_PARTS}, {_WORDS}, a AS (SELECT DISTINCT word, {_soundex_sql('word')} AS x FROM p), b AS (SELECT word AS document_word, n, {_soundex_sql('word')} AS y FROM w)
        SELECT word, document_word, n FROM a JOIN b ON x = y""",
}

_GROUPED = "CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_words"
_PART_W = "w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part)"
_DM = built_in_text()
_DM_WORDS = oracles.daitch_mokotoff(_WORDS, _DM, branching=False)
_ACCENTED = f"""w AS (SELECT word, count(*) AS n FROM (SELECT unnest(string_split_regex(text, '[^{ACCENTED_LETTERS}]+')) AS word FROM documents) WHERE regexp_matches(word, '[^A-Za-z]') GROUP BY 1)"""
_FOLDED = f"translate(replace(u.word, 'ß', 'ss'), '{match_rating.ACCENTED}', '{match_rating.PLAIN}')"


def _bm(files_kind: str, rule_type: str, most: int, name: str, given: str | None = None) -> str:
    return oracles.beider_morse(small_rules.ALL_TYPES, name, rule_type, most, files_kind, given)


ORACLES |= {
    "double_metaphone_words": f'{oracles.double_metaphone(_WORDS)} SELECT "primary", alternate, {_GROUPED} FROM w JOIN dmeta USING (word) GROUP BY ALL',
    "dm_words": f"{_DM_WORDS} SELECT code, {_GROUPED} FROM w JOIN dm USING (word) GROUP BY 1",
    "dm_alternatives": f"{oracles.daitch_mokotoff(_WORDS, _DM)} SELECT code, {_GROUPED} FROM w JOIN dm USING (word) GROUP BY 1",
    "dm_overlap_join": f"""{oracles.daitch_mokotoff(f"{_WORDS.replace('w AS', 'd AS', 1)}, {_PARTS}, w AS (SELECT word FROM d UNION SELECT word FROM p)", _DM)}
        SELECT DISTINCT a.word AS left_value, b.word AS right_value FROM dm a JOIN dm b ON a.code = b.code WHERE a.word IN (SELECT word FROM p) AND b.word IN (SELECT word FROM d)""",
    "mra_match_pairs": f"""WITH RECURSIVE {_PARTS}, a AS (SELECT DISTINCT word AS left_value, {_mra_sql('word')} AS a FROM p), b AS (SELECT DISTINCT c_mktsegment AS right_value, {_mra_sql('c_mktsegment')} AS b FROM customer),
        pairs AS (SELECT DISTINCT a, b FROM a, b), {oracles.match_rating('pairs')}
        SELECT left_value, right_value FROM a JOIN mra_rated USING (a) JOIN b USING (b) WHERE matches AND length(left_value) > 1 AND length(right_value) > 1
        UNION SELECT left_value, right_value FROM a JOIN b ON left_value = right_value WHERE length(left_value) > 1""",
    "bm_words": f"""WITH RECURSIVE {_PART_W}, {_bm('gen', 'approx', 20, 'bm_a')}, {_bm('gen', 'exact', 10, 'bm_e')}, {_bm('gen', 'exact', 10, 'bm_g', 'german')}
        SELECT word, bm_a.code AS approx, bm_e.code AS exact, bm_g.code AS german FROM bm_a JOIN bm_e USING (word) JOIN bm_g USING (word)""",
    "bm_languages": f"WITH {_PART_W} SELECT word, array_to_string({oracles.beider_morse_languages(small_rules.ALL_TYPES)}, '+') AS languages FROM w",
    "bm_document_words": f"WITH RECURSIVE {_WORDS}, "
    + ", ".join(_bm(kind, "exact", BM_PHONEMES, f"bm_{kind}") for kind in ("gen", "ash", "sep"))
    + " UNION ALL ".join(f" SELECT '{kind}' AS name_type, code, {_GROUPED} FROM w JOIN bm_{kind} USING (word) GROUP BY ALL" for kind in ("gen", "ash", "sep")),
    "dm_own_rules": f"{oracles.daitch_mokotoff(_WORDS, small_rules.DAITCH_MOKOTOFF, branching=False, folding=False)} SELECT code, {_GROUPED} FROM w JOIN dm USING (word) GROUP BY 1",
    "accented_words": f"""{oracles.daitch_mokotoff(_ACCENTED, _DM)}, {_cologne_sql("translate(upper(replace(word, 'ß', 'ss')), 'ÄÖÜ', 'AOU')")}
        SELECT u.word, u.n, left(d, 1) || replace(substr(d, 2), '0', '') AS cologne, {_mra_sql('u.word', _FOLDED)} AS match_rating,
               (SELECT string_agg(code, '|' ORDER BY code) FROM dm WHERE dm.word = u.word) AS daitch_mokotoff FROM u""",
    "double_metaphone_equality": f"""{oracles.double_metaphone(f"{_WORDS.replace('w AS', 'd AS', 1)}, {_PARTS}, w AS (SELECT word FROM d UNION SELECT upper(word) AS word FROM p)")},
        a AS (SELECT DISTINCT word, {_soundex_sql('word')} AS x FROM p), b AS (SELECT word AS other, {_soundex_sql('word')} AS y FROM d)
        SELECT a.word, other, m."primary" = o."primary" AS same, m.alternate = o.alternate AS same_alternate FROM a JOIN b ON x = y JOIN dmeta m ON m.word = upper(a.word) JOIN dmeta o ON o.word = b.other""",
}
