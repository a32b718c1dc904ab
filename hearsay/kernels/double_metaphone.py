"""Double Metaphone as an ordered table of letters in context."""

from __future__ import annotations

import re
from functools import lru_cache

from hearsay.native.text import blanks

# Fixed values. One rule a line: pattern; primary; alternate, = for the same; characters taken, * for all that the
# pattern matches; and what must hold (or, after !, must not hold) of the word. The first rule that fits decides.
# - is no code, _ a space.
_TABLE = r"""
\A[AEIOUY]; A; =; 1
BB?; P; =; *
Ç; S; =; 1
CHIA; K; =; 2
(?<=[^AEIOUY]A)CH(?![IE]); K; =; 2
(?<=[BM]A)CHER; K; =; 2
\ACAESAR; S; =; 2
(?<=.)CHAE; K; X; 2
\ACH(?=ARAC|ARIS|OR|YM|IA|EM)(?!ORE); K; =; 2
CH; K; =; 2; sch
(?<=OR)CH(?=ES|ID)|(?<=AR)CHIT; K; =; 2
(?<=..)CH[TS]; K; =; 2
(?:\A|(?<=[AOUE]))CH(?:[LRNMBHFVW ]|\Z); K; =; 2
(?<=.)CH; K; =; 2; mc
(?<=.)CH; X; K; 2
CH; X; =; 2
(?<!WI)CZ; S; X; 2
CCIA; X; =; 3
(?:(?<=\AA)CC(?=[IE]|H(?!U))|(?<=U)CC(?=E[ES])); KS; =; 3
(?<!\AM)CC(?=[IE]|H(?!U)); X; =; 3
(?<!\AM)CC; K; =; 2
C[KGQ]; K; =; 2
CI[OEA]; S; X; 2
C[IEY]; S; =; 2
C(?=[ ][CQG]); K; =; 3
C(?=[KQ]|C(?![EI])); K; =; 2
C; K; =; 1
DG[IEY]; J; =; 3
DG; TK; =; 2
D[TD]?; T; =; *
FF?; F; =; *
(?<=[^AEIOUY])GH; K; =; 2
\AGHI; J; =; 2
\AGH; K; =; 2
(?:(?<=[BHD].)|(?<=[BHD]..)|(?<=[BH]...))GH; -; =; 2
(?<=[CGLRT].U)GH; F; =; 2
(?<=[^I])GH; K; =; 2
GH; -; =; 2
(?<=\A[AEIOUY])GN; KN; N; 2; !slavic
GN(?!EY); N; KN; 2; !slavic
GN; KN; =; 2
GLI; KL; L; 2; !slavic
\AG(?=Y|E[SPBLYIR]|I[BLNE]); K; J; 2
(?<![EI])(?!(?<=[RO])GY)G(?=ER|Y); K; J; 2; !danger
G[EIY]|(?<=[AO])GGI; K; =; 2; german
GET; K; =; 2
GIER; J; =; 2
G[EIY]|(?<=[AO])GGI; J; K; 2
GG?; K; =; *
(?:\A|(?<=[AEIOUY]))H[AEIOUY]; H; =; 2
J; H; =; 1; san
\AJOSE(?=[ ]|\Z); H; =; 1
JOSE; J; H; 1
\AJJ?; J; A; *
(?<=[AEIOUY])J(?=[AO]); J; H; 1; !slavic
J\Z; J; _; 1
(?<![SKL])J(?![LTKSNMBZ])J?; J; =; *
JJ?; -; =; *
KK?; K; =; *
(?<=I)LL[OA]\Z|(?<=A)LLE\Z|(?<=A)LLE(?=.*[AO]S?\Z); L; -; 2
LL?; L; =; *
MM|(?<=U)MB(?=\Z|ER); M; =; 2
M; M; =; 1
NN?; N; =; *
Ñ; N; =; 1
PH; F; =; 2
P[PB]?; P; =; *
QQ?; K; =; *
(?<=..IE)(?<!M[EA]IE)R\Z; -; R; 1; !slavic
RR?; R; =; *
(?<=[IY])SL; -; =; 1
\ASUGAR; X; S; 1
SH(?=EIM|OEK|OLM|OLZ); S; =; 2
SH; X; =; 2
SI[OA]; S; =; 3; slavic
SI[OA]; S; X; 3
SZ; S; X; 2
\AS(?=[MNLW]); S; X; 1
SCH(?=E[RN]); X; SK; 3
SCH(?=OO|UY|E[DM]); SK; =; 3
\ASCH(?![AEIOUYW]); X; S; 3
SCH; X; =; 3
SC[IEY]; S; =; 3
SC; SK; =; 3
(?<=[AO]I)S\Z; -; S; 1
SS?; S; =; *
TION|TIA|TCH; X; =; 3
TH[OA]M; T; =; 2
TH|TTH; T; =; 2; german
TH|TTH; 0; T; 2
T[TD]?; T; =; *
VV?; F; =; *
WR; R; =; 2
\AW[AEIOUY]; A; F; 1
\AWH; A; =; 1
(?<=[AEIOUY])W\Z|(?<=[EO])WSK[IY]; -; F; 1
W; -; F; 1; sch
W(?:ICZ|ITZ); TS; FX; 4
\AX; S; =; 1
(?<=[AO]U)X\Z; -; =; 1
X[CX]?; KS; =; *
ZH; J; =; 2
Z(?=Z[OIA]); S; TS; 2
(?<=[^T])ZZ?; S; TS; *; slavic
ZZ?; S; =; *
"""
# Words with a silent start, and what rules ask of words.
_SILENT_START = re.compile("GN|KN|PN|WR|PS")
_PROPERTIES = {
    "slavic": re.compile("[WK]|CZ"),
    "sch": re.compile(r"\ASCH"),
    "german": re.compile(r"\A(?:VAN |VON |SCH)"),
    "mc": re.compile(r"\AMC"),
    "danger": re.compile(r"\A[DRM]ANGER"),
    "san": re.compile(r"\ASAN "),
}


@lru_cache(1)
def _rules() -> dict[str, list[tuple]]:
    """By the letter they are for."""
    out: dict[str, list[tuple]] = {}
    for line in _TABLE.strip().splitlines():
        pattern, primary, alternate, taken, *asked = (x.strip() for x in line.split(";"))
        primary = "" if primary == "-" else primary
        alternate = primary if alternate == "=" else {"-": "", "_": " "}.get(alternate, alternate)
        need = asked[0] if asked else ""
        rule = (re.compile(pattern, re.S).match, primary, alternate, 0 if taken == "*" else int(taken), need.lstrip("!"), not need.startswith("!"))
        bare = re.sub(r"\(\?[<!=]+(?:[^()]|\([^()]*\))*\)|\\[AZ]|\(\?:|[|)]", "", pattern)
        first = re.match(r"\[([A-Z]+)\]|(.)", bare)
        for letter in first[1] or first[2]:
            out.setdefault(letter, []).append(rule)
    return out


def double_metaphone(word: str, max_length: int | None = 4) -> tuple[str, str]:
    """Primary and alternate code, each of at most max_length characters; None: any number."""
    word = word.strip(blanks()).upper()
    holds = {name: bool(p.search(word)) for name, p in _PROPERTIES.items()}
    rules, primary, alternate, at = _rules(), [], [], 1 if _SILENT_START.match(word) else 0
    while at < len(word):
        step = 1
        for match, one, two, taken, need, wanted in rules.get(word[at], ()):
            if (not need or holds[need] == wanted) and (m := match(word, at)):
                primary.append(one)
                alternate.append(two)
                step = taken or m.end() - at
                break
        at += step
    return "".join(primary)[:max_length], "".join(alternate)[:max_length]
