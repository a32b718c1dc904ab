import pytest
from pyspark.sql import functions as F

from hearsay import functions as H
from hearsay.kernels.beider_morse import BeiderMorse, NameType, RuleSet, RuleType, alternatives, both, context, either, phonemes
from hearsay.kernels.daitch_mokotoff import DaitchMokotoff
from hearsay.plans import small_rules
from hearsay.rules.grammar import RuleError, lines
from hearsay.sources import rules as source


@pytest.fixture(scope="module")
def small():
    return RuleSet.parse(small_rules.FILES)


def kinds(text, *wanted):
    return [(x.number, x.kind, x.parts) for x in lines("t", text, wanted)]


def test_grammar():
    assert kinds('"a" "" "b|c" "d" // why\r\n\n  // only\n/* x\n y */\n"\\"" "1" "2" "3"', "rule") == [(1, "rule", ("a", "", "b|c", "d")), (6, "rule", ('\\"', "1", "2", "3"))]
    assert kinds("ß=s // f\n", "rule", "folding") == [(1, "folding", ("ß", "s"))]
    assert kinds("#include gen_a-b_1\nany\n", "include", "language") == [(1, "include", ("gen_a-b_1",)), (2, "language", ("any",))]
    assert kinds("^vogel$ german+x true\n", "detection") == [(1, "detection", ("^vogel$", "german+x", "true"))]
    for bad in ('"a" "b" "c"', "a = b", "/* open", "/* x */ y", "words here"):
        with pytest.raises(RuleError):
            kinds(bad, "rule", "folding")


def test_contexts():
    assert context("", True).kind == "all" and context("ab", True).holds("xab") and not context("ab", True).holds("abx")
    assert context("^", True).holds("") and not context("^", True).holds("a") and context("^ab", True).holds("ab")
    assert context("$", False).holds("") and context("b$", False).holds("b") and not context("b$", False).holds("bc")
    assert context("[^ab]", False).holds("c") and not context("[^ab]", False).holds("") and not context("[^ab]$", False).holds("cd")
    assert context("^[ab]", True).holds("a") and not context("^[ab]", True).holds("ca")
    assert context("(a|o)", False).holds("(a|o)x") and not context("(a|o)", False).holds("ax")  # no class: literal
    assert context("s[cz]", True).holds("xsc") and context("[ab]c[de]", False).holds("bcd")


def test_phonemes_and_languages():
    assert phonemes("(a[x+y]|b)") == (("a", frozenset("xy")), ("b", None))
    assert phonemes("(|a)") == (("", None), ("a", None), ("", None)) and phonemes("q") == (("q", None),)
    with pytest.raises(ValueError):
        phonemes("(a")
    x, y = frozenset("ab"), frozenset("bc")
    assert both(x, y) == {"b"} and both(None, y) == y and either(x, y) == {"a", "b", "c"} and either(x, None) is None


def test_engine(small):
    generic = BeiderMorse(small, rule_type=RuleType.EXACT)
    assert generic.guess("schill") == {"english"} and generic.guess("anna") == {"any", "english", "german"}
    assert generic.encode("schmid") == "Smid|Smit|skmid" and generic.encode_for("thor", frozenset(["german"])) == "tor"
    assert generic.encode("d'orn") == f"({generic.encode('orn')})-({generic.encode('dorn')})"
    assert generic.encode("van dam") == f"({generic.encode('dam')})-({generic.encode('vandam')})"
    apart = BeiderMorse(small, rule_type=RuleType.EXACT, concat=False)
    assert apart.encode("ada bob") == f"{generic.encode('ada')}-{generic.encode('bob')}"
    assert len(BeiderMorse(small, max_phonemes=2).encode("scchew").split("|")) <= 2 and BeiderMorse(small, max_phonemes=0).encode("ab") == ""
    assert generic.encode("") == "" and generic.encode("1234") == ""
    assert alternatives("(a|b)-(c|d)") == [["a", "b"], ["c", "d"]] and alternatives("a|b") == [["a", "b"]] and alternatives("x-y|z") == [["x"], ["y", "z"]]
    with pytest.raises(ValueError):
        BeiderMorse(small, NameType.SEPHARDIC)
    with pytest.raises(ValueError):
        generic.checked(["klingon"])
    undetected = BeiderMorse(RuleSet.parse(small_rules.FILES, detect=False))
    assert undetected.guess("schiller") is None and undetected.encode("ab") == "ab"


def test_includes_replace_buckets():
    files = {"gen_languages": "any\n", "gen_lang": "", "gen_rules_any": '"a" "" "" "1"\n"b" "" "" "2"\n#include more\n"a" "x" "" "4"\n', "more": '"a" "" "" "3"\n'}
    files |= {f"gen_{t}_{n}": "" for t in ("approx", "exact") for n in ("any", "common")}
    assert BeiderMorse(RuleSet.parse(files)).encode("ab") == "32"
    with pytest.raises(ValueError):
        RuleSet.parse({k: v for k, v in files.items() if k != "more"})


def test_columns_and_sources(spark, small, tmp_path):
    for name, text in small_rules.FILES.items():
        (tmp_path / f"{name}.txt").write_text(text, "utf-8")
    read = source.read_beider_morse(spark, str(tmp_path))
    engine = BeiderMorse(read)
    words = ["schiller", "Thorn", "d'orn", None]
    rows = spark.createDataFrame(list(enumerate(words)), "k int, w string").select("k", H.beider_morse("w", engine).alias("c"), H.beider_morse("w", engine, ["german"]).alias("g"), H.beider_morse_languages("w", engine).alias("l")).orderBy("k").collect()
    own = BeiderMorse(small)
    assert [r.c for r in rows] == [w and own.encode(w) for w in words]
    assert [r.g for r in rows] == [w and own.encode_for(w, frozenset(["german"])) for w in words]
    assert rows[0].l == ["english", "german"] and rows[3].l is None
    assert source.beider_morse_rules(spark, read).where("language = 'any' and rule_type = 'rules'").count() == len(small_rules.FILES["gen_rules_any"].strip().splitlines())
    assert source.daitch_mokotoff_rules(spark).count() == 124 and source.daitch_mokotoff_folding(spark).count() == 36
    (tmp_path / "own.dm").write_text('"a" "1" "2" "3"\nä=a\n', "utf-8")
    rules = source.read_daitch_mokotoff(spark, str(tmp_path / "own.dm"))
    assert rules.codes("äb") == ["100000"] and DaitchMokotoff.parse('"a" "1" "2" "3"\nä=a\n', False).codes("äa") == ["100000"]
    assert spark.createDataFrame([("aa",)], "w string").select(H.daitch_mokotoff("w", rules).alias("c")).first().c == "130000"
    assert F.col("x") is not None


def test_rule_sets_are_compiled_once_a_worker(small):
    import pickle

    a, b = (pickle.loads(pickle.dumps(BeiderMorse(small))) for _ in range(2))
    assert a.rule_set is b.rule_set and a.encode("schwartz") == BeiderMorse(small).encode("schwartz")


def test_name_types_have_rules_of_their_own():
    small = RuleSet.parse(small_rules.ALL_TYPES)
    for kind in NameType:
        assert BeiderMorse(small, kind, RuleType.EXACT).encode("thech")
    assert BeiderMorse(small, NameType.ASHKENAZI).encode("van") == "" != BeiderMorse(small, NameType.GENERIC).encode("van")


def test_language_sets_and_alternatives_as_columns(spark, small):
    df = spark.createDataFrame([(["a", "b"], ["b", "c"]), (None, ["b"]), (["a"], ["b"]), (None, None)], "x array<string>, y array<string>")
    rows = df.select(H.languages_both("x", "y"), H.languages_either("x", "y"), H.one_language("x")).collect()
    assert [tuple(r) for r in rows] == [(["b"], ["a", "b", "c"], None), (["b"], None, None), ([], ["a", "b"], "a"), (None, None, None)]
    got = spark.createDataFrame([("van thech",), (None,)], "w string").select(H.beider_morse_alternatives("w", BeiderMorse(small)).alias("a")).collect()
    assert got[0].a == alternatives(BeiderMorse(small).encode("van thech")) and len(got[0].a) == 2 and got[1].a is None


def test_published_rules(request):
    """Held against codes and guesses in a directory given with --beider-morse: rule files, and golden.tsv of name type, rule type, name, code."""
    import pathlib

    directory = request.config.getoption("--beider-morse")
    if not directory:
        pytest.skip("no directory of published rules given")
    rules = RuleSet.parse({p.stem: p.read_text("utf-8") for p in pathlib.Path(directory).glob("*.txt")})
    golden = pathlib.Path(directory) / "golden.tsv"
    rows = [x.split("\t") for x in golden.read_text("utf-8").splitlines() if x] if golden.exists() else []
    for kind, rule_type, name, code in rows:
        assert BeiderMorse(rules, NameType(kind), RuleType(rule_type)).encode(name) == code
    assert all(BeiderMorse(rules, NameType(k)).encode("Rosenberg") for k in rules.languages)
