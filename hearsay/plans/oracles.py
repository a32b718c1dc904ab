"""DuckDB SQL of the encoders with branches: Double Metaphone, Daitch-Mokotoff, Match Rating comparison, Beider-Morse.

Every statement walks words place by place in a recursive table. ``words`` is always a table expression ``w (word)``.
"""

from __future__ import annotations

from hearsay.kernels.beider_morse import PREFIXES, NameType
from hearsay.rules.grammar import lines


def text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


# Double Metaphone. b: the word before this place; r: the word from it on. The first condition that holds decides:
# primary code, alternate code, places taken.
def _r(pattern: str) -> str:
    return f"regexp_matches(r, '^(?:{pattern})')"


def _b(pattern: str) -> str:
    return f"regexp_matches(b, '(?:{pattern})$')"


def _double(letter: str, code: str) -> list[tuple[str, str]]:
    """A letter that is taken twice if it stands twice."""
    return [(_r(letter * 2), f"{code},{code},2"), (_r(letter), f"{code},{code},1")]


_START = "b = ''"
_DOUBLE_METAPHONE = [
    (f"{_START} AND {_r('[AEIOUY]')}", "A,A,1"), (_r("[AEIOUY]"), ",,1"), *_double("B", "P"),
    (_r("CHIA"), "K,K,2"), (f"{_b('[^AEIOUY]A')} AND {_r('CH')} AND NOT {_r('CH[IE]')}", "K,K,2"), (f"{_b('[BM]A')} AND {_r('CHER')}", "K,K,2"), (f"{_START} AND {_r('CAESAR')}", "S,S,2"),
    (f"b <> '' AND {_r('CHAE')}", "K,X,2"), (f"{_START} AND {_r('CH(ARAC|ARIS|OR|YM|IA|EM)')} AND NOT {_r('CHORE')}", "K,K,2"), (f"{_r('CH')} AND word LIKE 'SCH%'", "K,K,2"),
    (f"{_b('OR')} AND {_r('CH(ES|ID)')} OR {_b('AR')} AND {_r('CHIT')}", "K,K,2"), (f"length(b) > 1 AND {_r('CH[TS]')}", "K,K,2"), (f"({_START} OR {_b('[AOUE]')}) AND {_r('CH([LRNMBHFVW]|$)')}", "K,K,2"),
    (f"b <> '' AND {_r('CH')} AND word LIKE 'MC%'", "K,K,2"), (f"b <> '' AND {_r('CH')}", "X,K,2"), (_r("CH"), "X,X,2"), (f"{_r('CZ')} AND NOT {_b('WI')}", "S,X,2"), (_r("CCIA"), "X,X,3"),
    (f"b = 'A' AND ({_r('CC[IEH]')} AND NOT {_r('CCHU')}) OR {_b('U')} AND {_r('CCE[ES]')}", "KS,KS,3"), (f"b <> 'M' AND {_r('CC[IEH]')} AND NOT {_r('CCHU')}", "X,X,3"), (f"b <> 'M' AND {_r('CC')}", "K,K,2"),
    (_r("C[KGQ]"), "K,K,2"), (_r("CI[OEA]"), "S,X,2"), (_r("C[IEY]"), "S,S,2"), (f"{_r('C[KQ]')} OR {_r('CC')} AND NOT {_r('CC[EI]')}", "K,K,2"), (_r("C"), "K,K,1"),
    (_r("DG[IEY]"), "J,J,3"), (_r("DG"), "TK,TK,2"), (_r("D[TD]"), "T,T,2"), (_r("D"), "T,T,1"), *_double("F", "F"),
    (f"{_b('[^AEIOUY]')} AND {_r('GH')}", "K,K,2"), (f"{_START} AND {_r('GHI')}", "J,J,2"), (f"{_START} AND {_r('GH')}", "K,K,2"), (f"{_r('GH')} AND {_b('[BHD].|[BHD]..|[BH]...')}", ",,2"),
    (f"{_r('GH')} AND {_b('[CGLRT].U')}", "F,F,2"), (f"{_r('GH')} AND {_b('[^I]')}", "K,K,2"), (_r("GH"), ",,2"),
    (f"NOT slavic AND regexp_matches(b, '^[AEIOUY]$') AND {_r('GN')}", "KN,N,2"), (f"NOT slavic AND {_r('GN')} AND NOT {_r('GNEY')}", "N,KN,2"), (_r("GN"), "KN,KN,2"), (f"NOT slavic AND {_r('GLI')}", "KL,L,2"),
    (f"{_START} AND {_r('G(Y|E[SPBLYIR]|I[BLNE])')}", "K,J,2"), (f"{_r('G(ER|Y)')} AND NOT {_b('[EI]')} AND NOT ({_b('[RO]')} AND {_r('GY')}) AND NOT regexp_matches(word, '^[DRM]ANGER')", "K,J,2"),
    (f"({_r('G[EIY]')} OR {_b('[AO]')} AND {_r('GGI')}) AND word LIKE 'SCH%'", "K,K,2"), (_r("GET"), "K,K,2"), (_r("GIER"), "J,J,2"), (f"{_r('G[EIY]')} OR {_b('[AO]')} AND {_r('GGI')}", "J,K,2"), *_double("G", "K"),
    (f"({_START} OR {_b('[AEIOUY]')}) AND {_r('H[AEIOUY]')}", "H,H,2"), (_r("H"), ",,1"),
    (f"{_START} AND r = 'JOSE'", "H,H,1"), (_r("JOSE"), "J,H,1"), (f"{_START} AND {_r('JJ')}", "J,A,2"), (f"{_START} AND {_r('J')}", "J,A,1"), (f"NOT slavic AND {_b('[AEIOUY]')} AND {_r('J[AO]')}", "J,H,1"), ("r = 'J'", "J, ,1"),
    (f"NOT {_b('[SKL]')} AND {_r('JJ')}", "J,J,2"), (f"NOT {_b('[SKL]')} AND {_r('J')} AND NOT {_r('J[LTKSNMBZ]')}", "J,J,1"), (_r("JJ"), ",,2"), (_r("J"), ",,1"), *_double("K", "K"),
    (f"{_b('I')} AND {_r('LL[OA]$')} OR {_b('A')} AND ({_r('LLE$')} OR {_r('LLE.*[AO]S?$')})", "L,,2"), *_double("L", "L"), (f"{_r('MM')} OR {_b('U')} AND {_r('MB($|ER)')}", "M,M,2"), (_r("M"), "M,M,1"), *_double("N", "N"),
    (_r("PH"), "F,F,2"), (_r("P[PB]"), "P,P,2"), (_r("P"), "P,P,1"), *_double("Q", "K"), (f"NOT slavic AND r = 'R' AND {_b('..IE')} AND NOT {_b('M[EA]IE')}", ",R,1"), *_double("R", "R"),
    (f"{_b('[IY]')} AND {_r('SL')}", ",,1"), (f"{_START} AND {_r('SUGAR')}", "X,S,1"), (_r("SH(EIM|OEK|OLM|OLZ)"), "S,S,2"), (_r("SH"), "X,X,2"), (f"slavic AND {_r('SI[OA]')}", "S,S,3"), (_r("SI[OA]"), "S,X,3"), (_r("SZ"), "S,X,2"),
    (f"{_START} AND {_r('S[MNLW]')}", "S,X,1"), (_r("SCHE[RN]"), "X,SK,3"), (_r("SCH(OO|UY|E[DM])"), "SK,SK,3"), (f"{_START} AND {_r('SCH')} AND NOT {_r('SCH[AEIOUYW]')}", "X,S,3"), (_r("SCH"), "X,X,3"), (_r("SC[IEY]"), "S,S,3"), (_r("SC"), "SK,SK,3"),
    (f"{_b('[AO]I')} AND r = 'S'", ",S,1"), *_double("S", "S"), (_r("TION|TIA|TCH"), "X,X,3"), (_r("TH[OA]M"), "T,T,2"), (f"{_r('TH|TTH')} AND word LIKE 'SCH%'", "T,T,2"), (_r("TH|TTH"), "0,T,2"), (_r("T[TD]"), "T,T,2"), (_r("T"), "T,T,1"),
    *_double("V", "F"), (_r("WR"), "R,R,2"), (f"{_START} AND {_r('W[AEIOUY]')}", "A,F,1"), (f"{_START} AND {_r('WH')}", "A,A,1"), (f"{_b('[AEIOUY]')} AND r = 'W' OR {_b('[EO]')} AND {_r('WSK[IY]')}", ",F,1"), (f"{_r('W')} AND word LIKE 'SCH%'", ",F,1"),
    (_r("WICZ|WITZ"), "TS,FX,4"), (_r("W"), ",,1"), (f"{_START} AND {_r('X')}", "S,S,1"), (f"{_b('[AO]U')} AND r = 'X'", ",,1"), (_r("X[CX]"), "KS,KS,2"), (_r("X"), "KS,KS,1"),
    (_r("ZH"), "J,J,2"), (_r("ZZ[OIA]"), "S,TS,2"), (f"slavic AND {_b('[^T]')} AND {_r('ZZ')}", "S,TS,2"), (f"slavic AND {_b('[^T]')} AND {_r('Z')}", "S,TS,1"), *_double("Z", "S"),
]


def double_metaphone(words: str) -> str:
    """WITH RECURSIVE ..., dmeta (word, "primary", alternate) for words of A to Z."""
    said = " ".join(f"WHEN {condition} THEN '{out}'" for condition, out in _DOUBLE_METAPHONE)
    return f"""WITH RECURSIVE {words},
    dw AS (SELECT DISTINCT word, regexp_matches(word, 'W|K|CZ') AS slavic FROM w),
    dr AS (SELECT word, slavic, CASE WHEN regexp_matches(word, '^(GN|KN|PN|WR|PS)') THEN 2 ELSE 1 END AS i, '' AS p, '' AS a FROM dw
           UNION ALL SELECT word, slavic, i + CAST(o[3] AS INTEGER), p || o[1], a || o[2]
           FROM (SELECT *, string_split(CASE {said} ELSE ',,1' END, ',') AS o FROM (SELECT *, left(word, i - 1) AS b, substr(word, i) AS r FROM dr WHERE i <= length(word)))),
    dmeta AS (SELECT word, left(p, 4) AS "primary", left(a, 4) AS alternate FROM dr WHERE i > length(word))"""


def daitch_mokotoff(words: str, rules: str, branching: bool = True, folding: bool = True) -> str:
    """WITH RECURSIVE ..., dm (word, code) of each word's codes. rules: text of a rule file."""
    rows, folded = [], "lower(word)"
    for line in lines("rules", rules, ("rule", "folding")):
        if line.kind == "rule":
            pattern, *codes = line.parts
            rows.append(f"({text(pattern)}, {', '.join(f'string_split({text(c)}, {chr(39)}|{chr(39)})' for c in codes)})")
        elif folding:
            folded = f"replace({folded}, {text(line.parts[0])}, {text(line.parts[1])})"
    chosen = "xs" if branching else "xs[1:1]"
    return f"""WITH RECURSIVE {words},
    dm_rules (pattern, first, vowel, other) AS (VALUES {", ".join(rows)}),
    dm_words AS (SELECT DISTINCT word, {folded} AS name FROM w),
    dm_places AS (SELECT word, name, unnest(generate_series(1, length(name))) AS i FROM dm_words),
    dm_at AS (SELECT word, i, any_value(substr(name, i, 1)) AS now, arg_max({{'size': strlen(pattern), 'first': first, 'other': CASE WHEN regexp_matches(substr(name, i + strlen(pattern), 1), '[aeiou]') THEN vowel ELSE other END}}, length(pattern)) AS rule
              FROM dm_places JOIN dm_rules ON left(pattern, 1) = substr(name, i, 1) AND starts_with(substr(name, i), pattern) GROUP BY word, i),
    dm_known AS (SELECT DISTINCT left(pattern, 1) AS now FROM dm_rules),
    dm_steps AS (SELECT p.word, p.i, substr(p.name, p.i, 1) AS now, k.now IS NOT NULL AS known, a.rule FROM dm_places p LEFT JOIN dm_at a ON p.word = a.word AND p.i = a.i LEFT JOIN dm_known k ON k.now = substr(p.name, p.i, 1)),
    dm_lists AS (SELECT word, list({{'now': now, 'known': known, 'rule': rule}} ORDER BY i) AS steps FROM dm_steps GROUP BY word),
    dm_walk AS (SELECT word, length(name) AS size, steps, 1 AS i, '' AS before, '' AS digits, CAST(NULL AS VARCHAR) AS last FROM dm_words JOIN dm_lists USING (word)
           UNION SELECT word, size, steps, i + step, before_next, CASE WHEN x IS NULL THEN digits WHEN last IS NOT NULL AND (x = '' OR suffix(last, x)) AND NOT forced THEN digits ELSE left(digits || x, greatest(6, length(digits))) END, CASE WHEN x IS NULL THEN last ELSE x END
           FROM (SELECT *, unnest({chosen}) AS x FROM (SELECT word, size, steps, i, digits, last, CASE WHEN steps[i].known THEN steps[i].now ELSE before END AS before_next, coalesce(steps[i].rule.size, 1) AS step,
                        (before = 'm' AND steps[i].now = 'n') OR (before = 'n' AND steps[i].now = 'm') AS forced, CASE WHEN steps[i].rule IS NULL THEN [NULL] WHEN before = '' THEN steps[i].rule.first ELSE steps[i].rule.other END AS xs
                 FROM dm_walk WHERE i <= size) AS places) AS branches),
    dm AS (SELECT DISTINCT word, rpad(digits, 6, '0') AS code FROM dm_walk WHERE i > size)"""


def match_rating(pairs: str) -> str:
    """..., mra_rated (a, b, matches) over the distinct pairs of codes in table ``pairs`` (a, b); characters of ASCII only."""
    return f"""mra_walk AS (SELECT DISTINCT a, b, a AS x, b AS y, 0 AS i FROM {pairs} WHERE a <> '' AND b <> ''
       UNION ALL SELECT a, b, CASE WHEN right_same THEN left(x1, length(x1) - i - 1) || ' ' || right(x1, i) ELSE x1 END, CASE WHEN right_same THEN left(y1, length(y1) - i - 1) || ' ' || right(y1, i) ELSE y1 END, i + 1
       FROM (SELECT *, substr(x1, length(x1) - i, 1) = substr(y1, length(y1) - i, 1) AS right_same FROM (
             SELECT a, b, i, CASE WHEN substr(x, i + 1, 1) = substr(y, i + 1, 1) THEN left(x, i) || ' ' || substr(x, i + 2) ELSE x END AS x1, CASE WHEN substr(x, i + 1, 1) = substr(y, i + 1, 1) THEN left(y, i) || ' ' || substr(y, i + 2) ELSE y END AS y1
             FROM mra_walk WHERE i < least(length(a), length(b))))),
    mra_rated AS (SELECT a, b, abs(length(a) - length(b)) < 3 AND abs(6 - greatest(length(replace(x, ' ', '')), length(replace(y, ' ', '')))) >= CASE WHEN length(a) + length(b) <= 4 THEN 5 WHEN length(a) + length(b) <= 7 THEN 4 WHEN length(a) + length(b) <= 11 THEN 3 WHEN length(a) + length(b) = 12 THEN 2 ELSE 1 END AS matches
       FROM mra_walk WHERE i = least(length(a), length(b)))"""


def _phonemes(said: str) -> str:
    """A list of phonemes, each with its text and its languages, null for any."""
    inner = said[1:-1] if said.startswith("(") else said
    parts = inner.split("|") + ([""] if said.startswith("(") and (inner.startswith("|") or inner.endswith("|")) else [])
    out = []
    for p in parts:
        sign, _, named = p.partition("[")
        languages = "[" + ", ".join(map(text, named[:-1].split("+"))) + "]" if named else "CAST(NULL AS VARCHAR[])"
        out.append(f"{{'t': {text(sign)}, 'l': {languages}}}")
    return f"[{', '.join(out)}]"


def _rule_rows(files: dict[str, str], name: str) -> list[tuple[str, ...]]:
    """Rules of a file in order; the characters that an included file has replace those before it."""
    rows: list[tuple[str, ...]] = []
    for line in lines(name, files[name], ("rule", "include")):
        if line.kind == "include":
            own = _rule_rows(files, line.parts[0])
            rows = [r for r in rows if r[0][0] not in {o[0][0] for o in own}] + own
        else:
            rows.append(line.parts)
    return rows


def beider_morse_languages(files: dict[str, str], kind: str = "gen") -> str:
    """Expression for the languages a word may be of; null: any."""
    known = [x.parts[0] for x in lines("languages", files[f"{kind}_languages"], ("language",))]
    found = "[" + ", ".join(map(text, known)) + "]"
    for line in lines("lang", files[f"{kind}_lang"], ("detection",)):
        pattern, named, accept = line.parts
        own = "[" + ", ".join(map(text, named.split("+"))) + "]"
        kept = f"list_contains({own}, x)" if accept == "true" else f"NOT list_contains({own}, x)"
        found = f"list_filter({found}, lambda x: NOT regexp_matches(lower(word), {text(pattern)}) OR {kept})"
    return f"CASE WHEN len({found}) = 0 THEN NULL ELSE list_sort({found}) END"


def beider_morse(files: dict[str, str], name: str, rule_type: str, most: int, kind: str = "gen", given: str | None = None) -> str:
    """..., ``name`` (word, code) for table w (word) of words of ASCII letters without particles before others."""
    languages = [x.parts[0] for x in lines("languages", files[f"{kind}_languages"], ("language",))]
    rows = []
    for phase, own in (("rules", languages), (rule_type, ["common", *languages])):
        for language in own:
            for k, (pattern, before, after, said) in enumerate(_rule_rows(files, f"{kind}_{phase}_{language}")):
                rows.append(f"({text(phase)}, {text(language)}, {k}, {text(pattern)}, {text(before + '$')}, {text('^' + after)}, {_phonemes(said)})")
    empty = {(phase, language) for phase, own in ((rule_type, ["common", *languages]),) for language in own if not _rule_rows(files, f"{kind}_{phase}_{language}")}
    guess = f"[{text(given)}]" if given else beider_morse_languages(files, kind)
    dropped = PREFIXES[NameType(kind)] if kind != "gen" else ()
    spoken = f"CASE WHEN lower(word) IN ({', '.join(map(text, dropped))}) THEN '' ELSE lower(word) END" if dropped else "lower(word)"

    def walk(step: str, source: str, phase: str, language: str, keep: bool) -> str:
        """source (id, own, said, spoken): ``step`` (id, said, found) after all of ``said``."""
        grown = "flatten(list_transform(list_sort(found), lambda f: list_transform(p, lambda q: {'t': f.t || q.t, 'l': CASE WHEN f.l IS NULL THEN q.l WHEN q.l IS NULL THEN f.l ELSE list_intersect(f.l, q.l) END})))"
        other = "list_transform(found, lambda f: {'t': f.t || substr(said, i, 1), 'l': f.l})" if keep else "found"
        return f"""{step}_at AS (SELECT id, i, arg_min({{'size': length(pattern), 'p': p}}, ord) AS rule FROM (SELECT id, own, said, unnest(generate_series(1, length(said))) AS i FROM {source})
            JOIN {name}_rules ON phase = '{phase}' AND language = {language} AND left(pattern, 1) = substr(said, i, 1) AND starts_with(substr(said, i), pattern)
            WHERE CASE WHEN left_context = '$' THEN true ELSE regexp_matches(left(said, i - 1), left_context) END AND CASE WHEN right_context = '^' THEN true ELSE regexp_matches(substr(said, i + length(pattern)), right_context) END GROUP BY id, i),
        {step}_steps AS (SELECT id, list(rule ORDER BY i) AS steps FROM (SELECT id, unnest(generate_series(1, length(said))) AS i FROM {source}) LEFT JOIN {step}_at USING (id, i) GROUP BY id),
        {step}_walk AS (SELECT id, said, steps, 1 AS i, [{{'t': '', 'l': spoken}}] AS found FROM {source} LEFT JOIN {step}_steps USING (id)
            UNION ALL SELECT id, said, steps, i + size, CASE WHEN p IS NULL THEN {other} ELSE list_filter(h, lambda c, n: list_position(ts, c.t) = n)[1:{most}] END
            FROM (SELECT *, list_transform(h, lambda y: y.t) AS ts FROM (SELECT *, list_filter({grown}, lambda c: c.l IS NULL OR len(c.l) > 0) AS h
            FROM (SELECT id, said, steps, i, found, coalesce(steps[i].size, 1) AS size, steps[i].p AS p FROM {step}_walk WHERE i <= length(said))))),
        {step} AS (SELECT id, said, found FROM {step}_walk WHERE i > length(said))"""

    def finish(step: str, source: str, language: str) -> str:
        """source (word, own, t, l): ``step`` of the same kind; where texts meet, the languages of what the later ones were made from join in."""
        return f"""{step}_in AS (SELECT row_number() OVER () AS id, word, own, t AS said, l AS spoken FROM {source}),
        {walk(f"{step}_out", f"{step}_in", rule_type, language, True)},
        {step} AS (SELECT word, own, t, CASE WHEN bool_or(l IS NULL) THEN NULL ELSE list_distinct(flatten(list(l))) END AS l FROM (
            SELECT n.word, n.own, o.f.t AS t, CASE WHEN row_number() OVER (PARTITION BY n.word, o.f.t ORDER BY n.said) = 1 THEN o.f.l ELSE n.spoken END AS l
            FROM (SELECT id, unnest(found) AS f FROM {step}_out) o JOIN {step}_in n ON o.id = n.id) GROUP BY word, own, t)"""

    first, common, last = f"{name}_first", f"{name}_common", f"{name}_last"
    own_rules = "own" if not any((rule_type, x) in empty for x in languages) else None
    finished = f"{common} AS (SELECT * FROM {first}_all)" if (rule_type, "common") in empty else finish(common, f"{first}_all", "'common'")
    end = finish(last, common, own_rules) if own_rules else finish(f"{last}_own", f"{common}_own", "own") + f", {last} AS (SELECT * FROM {last}_own UNION ALL SELECT * FROM {common} WHERE own IN ({', '.join(text(x) for x in languages if (rule_type, x) in empty)}))"
    if not own_rules:
        end = f"{common}_own AS (SELECT * FROM {common} WHERE own NOT IN ({', '.join(text(x) for x in languages if (rule_type, x) in empty)})), " + end
    return f"""{name}_rules (phase, language, ord, pattern, left_context, right_context, p) AS (VALUES {", ".join(rows)}),
    {name}_words AS (SELECT word AS id, word, CASE WHEN len(guess) = 1 THEN guess[1] ELSE 'any' END AS own, {spoken} AS said, guess AS spoken FROM (SELECT DISTINCT word, {guess} AS guess FROM w)),
    {walk(first, f"{name}_words", "rules", "own", False)},
    {first}_all AS (SELECT word, own, f.t AS t, f.l AS l FROM (SELECT n.word, n.own, unnest(o.found) AS f FROM {first} o JOIN {name}_words n ON o.id = n.id)),
    {finished},
    {end},
    {name} AS (SELECT w.word, coalesce(code, '') AS code FROM {name}_words w LEFT JOIN (SELECT word, string_agg(t, '|' ORDER BY t) AS code FROM {last} GROUP BY word) USING (word))"""
