"""A few Beider-Morse rules of our own, for queries and tests; real rule files are a parameter of the engine."""

_RULES_ANY = """
"sch" "" "" "(S|sk[english])"
"ch" "" "[ei]" "(tS[english]|x[german])"
"ch" "" "" "(x|k)"
"th" "" "" "(t[german]|0[english])"
"ph" "" "" "f"
"ck" "" "" "k"
"ee" "" "" "(i[english]|e[german])"
"ie" "" "" "i"
"w" "^" "[aeiou]" "(v[german]|w[english])"
"a" "" "" "a"
"b" "" "" "b"
"c" "" "[eiy]" "(s|ts[german])"
"c" "" "" "k"
"d" "" "$" "(d|t[german])"
"d" "" "" "d"
"e" "[bcdfglmnrst]" "$" "(|e[german])"
"e" "" "" "e"
"f" "" "" "f"
"g" "" "[ei]" "(g|Z[english])"
"g" "" "" "g"
"h" "[aeiou]" "" ""
"h" "" "" "h"
"i" "" "" "i"
"j" "" "" "(j[german]|Z[english])"
"k" "" "" "k"
"l" "" "" "l"
"m" "" "" "m"
"n" "" "" "n"
"o" "" "" "o"
"p" "" "" "p"
"q" "" "" "k"
"r" "" "" "r"
"s" "" "[aeiou]" "(s|z[german])"
"s" "" "" "s"
"t" "" "" "t"
"u" "" "" "u"
"v" "" "" "(v[english]|f[german])"
"w" "" "" "(v|w[english])"
"x" "" "" "ks"
"y" "" "" "i"
"z" "" "" "(z[english]|ts[german])"
"""

#: Texts by name, as a rule directory would hold them.
FILES = {
    "gen_languages": "any\nenglish\ngerman\n",
    "gen_lang": "sch german+english true\nth$ english true\n[äöüß] german true\nw$ english true\nq english+german true\nll$ german false\n",
    "gen_rules_any": _RULES_ANY,
    "gen_rules_english": '#include gen_rules_any\n"th" "" "" "0"\n"t" "" "" "t"\n"j" "" "" "Z"\n',
    "gen_rules_german": '#include gen_rules_any\n"w" "" "" "v"\n"z" "" "" "ts"\n"v" "" "" "f"\n',
    "gen_approx_common": '"Z" "" "" "(S|Z)"\n"0" "" "" "t"\n"d" "" "$" "t" // final\n',
    "gen_approx_any": '"e" "" "" "(e|i)"\n',
    "gen_approx_english": '"e" "" "[lr]$" "(i|)"\n',
    "gen_approx_german": '"o" "" "" "(o|u)"\n',
    "gen_exact_common": '/* nothing\n is changed */\n"ss" "" "" "s"\n',
    "gen_exact_any": "",
    "gen_exact_english": "",
    "gen_exact_german": '"ts" "^" "" "z"\n',
}

#: The same few rules for all three name types, each under its own names.
ALL_TYPES = {name.replace("gen_", f"{kind}_", 1): text.replace("gen_", f"{kind}_") for kind in ("gen", "ash", "sep") for name, text in FILES.items()}

#: A few Daitch-Mokotoff rules and a folding of our own.
DAITCH_MOKOTOFF = """
"a" "0" "" ""
"e" "0" "" "|7"
"b" "7" "7" "7"
"th" "3|0" "3" "|3"
"t" "3" "3" "3"
"he" "5" "" "5"
"n" "6" "6" "6"
"m" "6" "6" "6"
"ing" "0" "65" "65|6"
"ö" "0" "" ""
ü=u
é=e
"""
