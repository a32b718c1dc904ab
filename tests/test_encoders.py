import random

import pytest
from pyspark.sql import functions as F

from hearsay import functions as H
from hearsay.kernels import daitch_mokotoff, double_metaphone, match_rating, metaphone, nysiis, phonex
from hearsay.operators import codes as ops

# Words and their codes.
SOUNDEX = {"testing": "T235", "The": "T000", "quick": "Q200", "brown": "B650", "jumped": "J513", "BOOTH-DAVIS": "B312", "Tymczak": "T522", "Pfister": "P236", "HERMAN": "H655", "Ashcraft": "A261", "O'Hara": "O600", "": "", " ": "", "1a": "A000", "Williams": "W452", "Straße": "S362"}
GENEALOGY = {"Heggenburger": "H251", "Dodds": "D200", "Lippmann": "L150"}
REFINED = {"testing": "T6036084", "The": "T60", "quick": "Q503", "brown": "B1908", "fox": "F205", "jumped": "J408106", "over": "O0209", "lazy": "L7050", "dogs": "D6043", "": ""}
CAVERPHONE1 = {"David": "TFT111", "Whittle": "WTL111", "Thompson": "TMPSN1", "mb": "M11111", "mbmb": "MPM111", "": "111111", "Peter": "PT1111"}
CAVERPHONE2 = {"Stevenson": "STFNSN1111", "Peter": "PTA1111111", "ready": "RTA1111111", "social": "SSA1111111", "able": "APA1111111", "Karleen": "KLN1111111", "mb": "M111111111", "": "1111111111"}
COLOGNE = {"müller": "657", "schmidt": "862", "schneider": "8627", "fischer": "387", "weber": "317", "wagner": "3467", "becker": "147", "hoffmann": "0366", "schäfer": "837", "Breschnew": "17863", "Wikipedia": "3412", "peter": "127", "pharma": "376", "mönchengladbach": "664645214", "deutsch": "28", "deutz": "28", "alexander": "0548627", "xch": "484", "ac": "08", "ca": "4", "hc": "8", "": ""}
NYSIIS = {"WESTERLUND": "WASTAR", "Brian": "BRAN", "Capp": "CAP", "Dent": "DAD", "Phil": "FAL", "": "", "MACINTOSH": "MCANT", "KNUTH": "NAT", "BART": "BAD"}
NYSIIS_FULL = {"PHILLIPSON": "FALAPSAN", "HEITSCHMIDT": "HATSNAD", "SCHOENHOEFT": "SANAFT", "MCKEE": "MCY"}
PHONEX = {"123 testsss": "T230", "Ashcraft": "A261", "Kuhne": "C500", "Hornblower": "A514", "Sandemann": "S500", "": "0000", "Meyer-Lansky": "M452"}
METAPHONE = {"howl": "HL", "testing": "TSTN", "The": "0", "SASH": "SX", "quick": "KK", "KNIGHT": "NT", "DUMB": "TM", "SCHEDULE": "SKTL", "PHISH": "FX", "WHITE": "WT", "a": "A", "2": "2"}
DOUBLE = {"testing": ("TSTN", "TSTN"), "zhao": ("J", "J"), "wachtler": ("AKTL", "FKTL"), "Jose": ("HS", "HS"), "smith": ("SM0", "XMT"), "Beech": ("PK", "PK"), "caesar": ("SSR", "SSR"), "Michael": ("MKL", "MXL"), "bacher": ("PKR", "PKR"), "Schmidt": ("XMT", "SMT"), "angier": ("ANJ", "ANJR"), "laugh": ("LF", "LF"), "": ("", "")}
MATCH_RATING = {"HARPER": "HRPR", "Smith": "SMTH", "E": "", " ": "", "Kathryn": "KTHRYN", "Christopherson": "CHRRSN"}
DM = {"AUERBACH": "097400", "OHRBACH": "097400", "LIPSHITZ": "874400", "LEWINSKY": "876450", "SZLAMAWICZ": "486740", "": "000000"}
DM_ALL = {"Jackson": "154600|145460|454600|445460", "ţamas": "364000|464000", "Rosochowaciec": "944744|944745|944754|944755|945744|945745|945754|945755", "Peters": "734000|739400"}


def column_codes(spark, encode, words):
    rows = spark.createDataFrame(list(enumerate(words)), "k int, w string").select("k", encode(F.col("w")).alias("c")).orderBy("k").collect()
    return [r.c for r in rows]


@pytest.mark.parametrize(
    "encode, want",
    [
        (H.soundex, SOUNDEX),
        (lambda c: H.soundex(c, H.GENEALOGY), GENEALOGY),
        (H.refined_soundex, REFINED),
        (H.caverphone1, CAVERPHONE1),
        (H.caverphone2, CAVERPHONE2),
        (H.cologne, COLOGNE),
        (H.match_rating, MATCH_RATING),
        (H.nysiis, NYSIIS),
        (lambda c: H.nysiis(c, strict=False), NYSIIS_FULL),
        (H.phonex, PHONEX),
        (H.metaphone, METAPHONE),
        (lambda c: H.double_metaphone(c)["primary"], {k: v[0] for k, v in DOUBLE.items()}),
        (lambda c: H.double_metaphone(c)["alternate"], {k: v[1] for k, v in DOUBLE.items()}),
        (H.daitch_mokotoff, DM),
        (H.daitch_mokotoff_soundex, DM_ALL),
    ],
)
def test_codes(spark, encode, want):
    assert dict(zip(want, column_codes(spark, encode, list(want)))) == want
    assert column_codes(spark, encode, [None]) == [None]


def test_options(spark):
    assert column_codes(spark, lambda c: H.soundex(c, H.ENGLISH, False), ["Dodds", "Dhdds", "Dwdds"]) == ["D320", "D320", "D320"]
    assert column_codes(spark, H.soundex, ["Müller", "Testingé", "Łódź"]) == [None, "T235", None]
    assert column_codes(spark, H.refined_soundex, ["Müller"]) == [None]
    assert column_codes(spark, lambda c: H.metaphone(c, None), ["synchronization"]) == ["SNXRNSXN"]
    assert column_codes(spark, lambda c: H.metaphone(c, 6), ["AXEAXEAXE"]) == ["AKSKSK"]
    with pytest.raises(ValueError):
        H.soundex("w", "0123")
    assert phonex.phonex("MDA", 4)[:2] == "M5" and double_metaphone.double_metaphone("testing", 0) == ("", "")
    assert double_metaphone.double_metaphone("Bj")[1].endswith(" ")
    assert nysiis.nysiis("abcdeé") is None


def test_comparisons(spark):
    same = [("Smith", "Smyth", True), ("Catherine", "Kathryn", True), ("", "a", False), ("A", "A", False), ("--", "--", True), ("--", "..", False), ("Brian", "Bryan", True), ("Burns", "Bourne", True), ("Peter", "Stevenson", False), ("Karl", None, None)]
    df = spark.createDataFrame(same, "a string, b string, want boolean").select("*", H.match_rating_equal("a", "b").alias("got"))
    assert all(r.want == r.got for r in df.collect())
    pairs = [("Smith", "Smythe", 4), ("Ann", "Andrew", 2), ("Margaret", "Andrew", 1), ("Janet", "Margaret", 0), ("Green", "Greene", 4), ("Blotchet-Halls", "Greene", 0), ("", "Green", 0)]
    df = spark.createDataFrame(pairs, "a string, b string, want int").select("*", H.soundex_difference("a", "b").alias("got"))
    assert all(r.want == r.got for r in df.collect())
    pairs = [("Smith", "Smythe", 6), ("Ann", "Andrew", 3), ("Smithers", "Smythers", 8), ("Anothers", "Brothers", 5), ("", "", 0)]
    df = spark.createDataFrame(pairs, "a string, b string, want int").select("*", H.refined_soundex_difference("a", "b").alias("got"))
    assert all(r.want == r.got for r in df.collect())
    row = spark.createDataFrame([("Case", "case")], "a string, b string").select(H.encoded_equal("a", "b", H.metaphone).alias("x"), H.double_metaphone_equal("a", "b", True).alias("y")).first()
    assert row.x and row.y


def test_joins_lose_no_pair(spark):
    rng = random.Random(6)
    left = ["".join(rng.choices("abcdeghkmnrst", k=rng.randint(1, 7))) for _ in range(60)] + ["", "--", None, "Kathryn"]
    right = ["".join(rng.choices("abcdeghkmnrst", k=rng.randint(1, 7))) for _ in range(60)] + left[:5] + ["", "--", "Catherine"]
    x, y = (spark.createDataFrame([(w,) for w in words], "w string") for words in (left, right))
    every = x.where("w is not null").select(F.col("w").alias("a")).distinct().crossJoin(y.where("w is not null").select(F.col("w").alias("b")).distinct())
    want = {(r.a, r.b) for r in every.where(H.match_rating_equal("a", "b")).collect()}
    assert {tuple(r) for r in ops.match_rating_join(x, y, "w", "w").collect()} == want and ("--", "--") in want
    for least in (1, 2, 3, 4):
        want = {tuple(r) for r in every.withColumn("d", H.soundex_difference("a", "b")).where(F.col("d") >= least).collect()}
        assert {tuple(r) for r in ops.difference_join(x, y, "w", "w", least).collect()} == want
    want = {tuple(r) for r in every.where(F.arrays_overlap(H.daitch_mokotoff_codes("a"), H.daitch_mokotoff_codes("b"))).collect()}
    assert {tuple(r) for r in ops.overlap_join(x, y, "w", "w", H.daitch_mokotoff_codes).where("left_value is not null").collect()} == want
    with pytest.raises(ValueError):
        ops.difference_join(x, y, "w", "w", 0)


def test_operators(spark):
    df = spark.createDataFrame([("Smith", 1), ("Smyth", 2), ("Smith", 3), (None, 4), ("", 5)], "w string, n int")
    assert {(r.code, r.n_rows, r.n_values) for r in ops.group_by_code(df, "w", H.soundex).collect()} == {("S530", 3, 2), (None, 1, 0), ("", 1, 1)}
    got = {(r.n, r.code) for r in ops.encode_distinct(df, "w", H.phonex).collect()}
    assert got == {(1, "S530"), (2, "S530"), (3, "S530"), (4, None), (5, "0000")}
    other = spark.createDataFrame([("Smithe",), ("",)], "v string")
    assert ops.code_join(df, other, "w", "v", H.soundex).count() == 4
    assert ops.code_join(df, other, "w", "v", H.soundex, drop_empty=True).count() == 3
    assert ops.code_join(df, other, "w", "v", H.soundex, "left_anti").count() == 1


def test_joins_encode_each_side_once(spark):
    x, y = (spark.createDataFrame([("a",)], f"{c} string") for c in "vw")
    plan = ops.code_join(x, y, "v", "w", H.phonex)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2


def test_native_plans_have_no_python(spark):
    df = spark.createDataFrame([("a",)], "w string")
    for encode in (H.soundex, H.refined_soundex, H.caverphone1, H.caverphone2, H.cologne, H.match_rating):
        plan = df.select(encode("w"))._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan


def test_registration(spark):
    class Shout:
        """A user's encoder."""

        def encode(self, word):
            return word.upper() + "!"

    names = H.register_all(spark)
    got = spark.sql(f"SELECT {', '.join(n + chr(40) + chr(39) + 'Thompson' + chr(39) + chr(41) + f' AS c{k}' for k, n in enumerate(names))}").first()
    assert len(got) == len(names) == 14 and all(got)
    assert spark.sql("SELECT phonetic_soundex(w) AS s, phonetic_caverphone2(w) AS c FROM VALUES ('Thompson') AS t(w)").first() == ("T512", "TMPSN11111")
    H.register(spark, "shout", Shout())
    assert spark.sql("SELECT shout('ab') AS x").first().x == "AB!"


def test_kernels_on_odd_words():
    rng = random.Random(8)
    for _ in range(3000):
        w = "".join(rng.choices("ABCDEGHIJKLMNOPQRSTUVWXYZ -'é1ß", k=rng.randint(0, 9)))
        assert len(phonex.phonex(w).encode()) in (4, 5)
        assert len(metaphone.metaphone(w)) <= 4 and len(nysiis.nysiis(w, False) or "") <= len(w) * 2
        assert all(len(c) == 6 and c.isdigit() for c in daitch_mokotoff.built_in().codes(w))
        a, b = double_metaphone.double_metaphone(w)
        assert len(a) <= 4 and len(b) <= 4
    assert match_rating.least_rating(4) == 5 and match_rating.least_rating(13) == 1 and match_rating.rating("AB", "BA") == 4


def test_rating_join_meets_few_other_pairs(spark):
    rng = random.Random(3)
    codes = sorted({"".join(rng.choices("BCDFGHKLMNPRST", k=rng.choice([3, 4, 5, 6, 6, 6]))) for _ in range(900)})
    x, y = (spark.createDataFrame([(c,) for c in codes], f"{side}_code string") for side in ("left", "right"))
    near = {tuple(r) for r in ops.match_rating_candidates(x, y).collect()}
    want = {(a, b) for a in codes for b in codes if match_rating.codes_match(a, b)}
    assert want <= near and len(near) < 1.2 * len(want) and len(near) < 0.1 * len(codes) ** 2


def test_rating_join_of_codes_beyond_ascii(spark):
    words = ["Øre", "Øra", "Ørd", "øre", "Łódź", "Łodz", "Lodz", "é", "ée", "日本", "日本語", "日", "a", "ab", "Kathryn", None]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    every = df.where("w is not null").select(F.col("w").alias("a")).crossJoin(df.where("w is not null").select(F.col("w").alias("b")))
    want = {tuple(r) for r in every.where(H.match_rating_equal("a", "b")).collect()}
    assert {tuple(r) for r in ops.match_rating_join(df, df, "w", "w").collect()} == want


def test_overlap_join_deals_out_common_codes(spark):
    words = [f"{a}{b}{c}" for a in ("Jack", "Pet", "Chor") for b in ("son", "ers", "a") for c in ("", "e", "i", "o", "h")]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    codes = {w: set(daitch_mokotoff.built_in().codes(w)) for w in words}
    want = sorted((a, b) for a in words for b in words if codes[a] & codes[b])
    for block in (10_000, 3):
        assert sorted(tuple(r) for r in ops.overlap_join(df, df, "w", "w", H.daitch_mokotoff_codes, block).collect()) == want


def test_on_error(spark):
    words = ["Müller", "Thompson", None]
    assert column_codes(spark, lambda c: H.soundex(c, on_error="null"), words) == [None, "T512", None]
    assert column_codes(spark, lambda c: H.soundex(c, on_error="raise"), words[1:]) == ["T512", None]
    for encode in (H.soundex, H.refined_soundex):
        with pytest.raises(Exception, match="no code for Müller"):
            column_codes(spark, lambda c: encode(c, on_error="raise"), words)
    with pytest.raises(Exception, match="no code for abcdeé"):
        column_codes(spark, lambda c: H.nysiis(c, on_error="raise"), ["abcdeé"])
    with pytest.raises(ValueError):
        H.caverphone2("w", on_error="skip")


def test_difference_of_any_encoder(spark):
    df = spark.createDataFrame([("Thompson", "Thomson"), ("Smith", "Xu"), (None, "a")], "a string, b string")
    got = df.select(H.difference("a", "b", H.caverphone2)).collect()
    assert [r[0] for r in got] == [7, 7, None]


def test_options_and_pairs_in_sql(spark):
    names = H.register_options(spark)
    assert len(names) == 8
    row = spark.sql("SELECT phonetic_nysiis_full('PHILLIPSON') AS a, phonetic_metaphone_of('AXEAXEAXE', 6) AS b, phonetic_soundex_difference('Smith', 'Smythe') AS c, phonetic_refined_soundex_difference('Smithers', 'Smythers') AS d, phonetic_daitch_mokotoff_codes('Jackson') AS e, phonetic_phonex_of('123 testsss', 4) AS f").first()
    assert tuple(row) == ("FALAPSAN", "AKSKSK", 4, 8, ["154600", "145460", "454600", "445460"], "T230")
