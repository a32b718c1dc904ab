"""NYSIIS."""

from __future__ import annotations

import re

from hearsay.kernels.lexer import letters

# Starts and ends, each tried in order.
_STARTS = ((r"\AMAC", "MCC"), (r"\AKN", "NN"), (r"\AK", "C"), (r"\AP[HF]", "FF"), (r"\ASCH", "SSS"))
_ENDS = ((r"(?:EE|IE)\Z", "Y"), (r"(?:DT|RT|RD|NT|ND)\Z", "D"))
# What a place is rewritten to before its letter is taken, the first that fits.
_STEPS = (("EV", "AF"), ("A", "A"), ("E", "A"), ("I", "A"), ("O", "A"), ("U", "A"), ("Q", "G"), ("Z", "S"), ("M", "N"), ("KN", "NN"), ("K", "C"), ("SCH", "SSS"), ("PH", "FF"))
_BY_LETTER = {x: [(a, b) for a, b in _STEPS if a[0] == x] for x in "AEIOUQZMKSP"}
_FINISH = ((r"S\Z", ""), (r"(?<=.)AY\Z", "Y"), (r"A\Z", ""))
_VOWELS = "AEIOU"
STRICT_LENGTH = 6


def nysiis(word: str, strict: bool = True) -> str | None:
    """The code; strict: at most six bytes, None if a letter beyond ASCII would be cut."""
    word = letters(word)
    if not word:
        return ""
    for pattern, to in (*_STARTS, *_ENDS):
        word = re.sub(pattern, to, word)
    signs = list(word)
    key = [signs[0]]
    for at in range(1, len(signs)):
        before, now = signs[at - 1], signs[at]
        ahead = "".join(signs[at : at + 3])
        if now == "H":
            if before not in _VOWELS or ahead[1:2] == "" or ahead[1] not in _VOWELS:
                signs[at] = before
        elif now == "W":
            if before in _VOWELS:
                signs[at] = before
        else:
            for found, to in _BY_LETTER.get(now, ()):
                if ahead.startswith(found):
                    signs[at : at + len(to)] = to
                    break
        if signs[at] != before:
            key.append(signs[at])
    code = "".join(key)
    if len(code.encode()) > 1:
        for pattern, to in _FINISH:
            code = re.sub(pattern, to, code, flags=re.S)
    if not strict:
        return code
    try:
        return code.encode()[:STRICT_LENGTH].decode()
    except UnicodeDecodeError:
        return None
