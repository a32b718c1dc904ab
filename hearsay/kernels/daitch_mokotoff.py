"""Daitch-Mokotoff codes with branches."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from importlib import resources

from hearsay.native.text import blanks
from hearsay.rules.grammar import lines

LENGTH = 6
_VOWELS = "aeiou"


@dataclass(frozen=True)
class Rule:
    """Codes at the start of a word, before a vowel, elsewhere. size: of the pattern in UTF-8 bytes, by which a match advances."""

    pattern: str
    size: int
    codes: tuple[tuple[str, ...], tuple[str, ...], tuple[str, ...]]

    def replacements(self, rest: str, start: bool) -> tuple[str, ...]:
        """rest: the word from the match on."""
        if start:
            return self.codes[0]
        vowel = self.size < len(rest.encode()) and rest[self.size : self.size + 1] in tuple(_VOWELS)
        return self.codes[1] if vowel else self.codes[2]


@dataclass(frozen=True)
class DaitchMokotoff:
    """Rules by first character, the longest pattern first, and the folding of characters."""

    rules: dict[str, tuple[Rule, ...]]
    folding: dict[int, str]

    @classmethod
    def parse(cls, text: str, ascii_folding: bool = True, name: str = "rules") -> DaitchMokotoff:
        rules: dict[str, list[Rule]] = {}
        folding: dict[int, str] = {}
        for line in lines(name, text, ("rule", "folding")):
            if line.kind == "folding":
                folding[ord(line.parts[0])] = line.parts[1]
            else:
                pattern, *codes = line.parts
                rules.setdefault(pattern[0], []).append(Rule(pattern, len(pattern.encode()), tuple(tuple(c.split("|")) for c in codes)))
        longest_first = {k: tuple(sorted(v, key=lambda r: -r.size)) for k, v in rules.items()}
        return cls(longest_first, folding if ascii_folding else {})

    def codes(self, word: str, branching: bool = True) -> list[str]:
        """Codes of six digits, in the order in which their branches arose; without branching, the first."""
        blank = blanks()
        word = "".join((c.lower()[:1] or c) for c in word if c not in blank).translate(self.folding)
        # a branch is its digits and what was added last
        branches: dict[tuple[str, str | None], None] = {("", None): None}
        before, at = "", 0
        while at < len(word):
            now, step = word[at], 1
            if bucket := self.rules.get(now):
                rule = next((r for r in bucket if word.startswith(r.pattern, at)), None)
                if rule:
                    forced = {before, now} == {"m", "n"}
                    new = rule.replacements(word[at:], not before)
                    new = new if branching else new[:1]
                    branches = {(digits if last is not None and last.endswith(x) and not forced else (digits + x)[: max(LENGTH, len(digits))], x): None for digits, last in branches for x in new}
                    step = max(1, rule.size)
                before = now
            at += step
        return [digits.ljust(LENGTH, "0") for digits, _ in branches]

    def soundex(self, word: str) -> str:
        return "|".join(self.codes(word))

    def encode(self, word: str) -> str:
        return self.codes(word, branching=False)[0]


def built_in_text() -> str:
    """Text of the rules that come with the package."""
    return resources.files("hearsay.rules").joinpath("daitch_mokotoff.txt").read_text("utf-8")


@lru_cache(2)
def built_in(ascii_folding: bool = True) -> DaitchMokotoff:
    """The rules that come with the package."""
    return DaitchMokotoff.parse(built_in_text(), ascii_folding)
