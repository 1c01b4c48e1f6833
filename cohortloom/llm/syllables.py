"""Syllables by hyphenation patterns.

A pattern is a piece of a word with numbers between its letters; a dot is the word's beginning or
end. At each place the highest number of all patterns that fit counts: an odd one is a break. Patterns
for consonants and endings are made from rules over the letters, those for vowels side by side are listed.
"""

from __future__ import annotations

import functools
import re
import unicodedata

_VOWELS = "aeiouy"
_CONSONANTS = "bcdfghjklmnpqrstvwxz"

#: Vowels side by side that are two sounds (odd) or one after all (even), and single words.
_LISTED = """
i1a ci2a ti2a si2a gi2a ri2age li2a1ble .di3a via3
i1o ti2o si2o ci2o gi2o xi2o ni2on li2on .li3on .ri3ot .pi3o
i1u
sci3e qui1et cli1e di1et soci1e vari1e i1ety audi1e ri1en hygi2e di1en ti2en ci2en fri2en tri1en ori1ent i1er. i1est. i1ers. .pi2er. .ti2er. i1ent. ti2ent. ci2ent.
e1o pe2o le2op ge2o ne1ou e1yo
cre1a .re1a re1act are1a ide1a the1a ce2an rhe1a se1a. ne1ar cle1ar me1a1b lle1a .be1a1t2i
u1a qu2a gu2a su2ad
u1o qu2o bu2oy gu2o
u1en qu2en gu2en u1el qu2el gu2el
flu1i tu1i nu1i ru1in su1ic qu2i gu2i
a1os .co1a .co1e .co1o1p .co1in1c po1em po1et o1ing e1ing u1ing i1ing y1ing y1a y1o fly1er dry1er cry1er .la2w3y2er .di3a3be3tes. .e2y2e. hy1e qu2ing
.be1i .re1i .re1u .re1o .re1e .pre1e .pre1o .pre1a .re3a3l se1um le1um ne1um
s3m. th3m. s3ms.
.bu2si3ness .ca3fe. .re3ci3pe .si3mi3le. .so2me1 .ev2ery .el3e3ment .im3ple3ment .com3ple3ment .sup3ple3ment .in3cre3ment .ca3tas3tro3phe .e3pi3to3me. .a3po3stro3phe
.syn3co3pe. .a3cne. .ape3x .fore1 .wed2nes .choc2o .co2lo3nel .bu2si3ly
"""


def _generated() -> list[str]:
    """Patterns from rules over the letters."""
    out = [f"1{c}{v}" for c in _CONSONANTS for v in _VOWELS]  # a syllable begins with the last consonant before its vowel
    out += [f"{v}1y2{w}" for v in "aeou" for w in "aeiou"]
    out += [f"2{c}e." for c in _CONSONANTS]  # the silent e of an ending
    out += [f"3{c}2le." for c in _CONSONANTS if c not in "lrwhy"] + [f"3{c}2led." for c in _CONSONANTS if c not in "lrwhy"] + [f"3{c}2les." for c in _CONSONANTS if c not in "lrwhy"]
    out += [f"2{c}ed." for c in _CONSONANTS + "y" if c not in "td"]
    out += [f"2{c}es." for c in _CONSONANTS if c not in "szxcgh"] + [f"{c}2hes." for c in "tpg"]
    out += [f"2{c}e1{ending}" for c in _CONSONANTS for ending in ("ly.", "less", "ful", "ment.", "ments.", "ness")]
    return out


def _parsed(pattern: str) -> tuple[str, tuple[int, ...]]:
    """The letters of a pattern and the number before each of them and behind the last."""
    letters, levels = [], [0]
    for c in pattern:
        if c.isdigit():
            levels[-1] = int(c)
        else:
            letters.append(c)
            levels.append(0)
    return "".join(letters), tuple(levels)


def _table() -> dict[str, tuple[int, ...]]:
    out: dict[str, tuple[int, ...]] = {}
    for letters, levels in map(_parsed, [*_generated(), *_LISTED.split()]):
        out[letters] = tuple(map(max, out[letters], levels)) if letters in out else levels
    return out


PATTERNS = _table()
_LONGEST = max(map(len, PATTERNS))
_SPLIT = re.compile(r"[-'’]")


def _plain(word: str) -> str:
    """Lower-case letters without marks; a marked final e is written as a vowel that is never silent."""
    word = unicodedata.normalize("NFKD", re.sub("[éèêë]$", "i", word.lower().replace("æ", "e").replace("œ", "e").replace("ø", "o").replace("ß", "ss").replace("ı", "i")))
    return "".join(c for c in word if c.isascii() and c.isalpha())


def breaks(word: str) -> list[int]:
    """Places in a plain word where a syllable begins, the first left out."""
    dotted = f".{word}."
    levels = [0] * (len(dotted) + 1)
    for begin in range(len(dotted)):
        for end in range(begin + 1, min(len(dotted), begin + _LONGEST) + 1):
            found = PATTERNS.get(dotted[begin:end])
            if found:
                for i, level in enumerate(found, begin):
                    if level > levels[i]:
                        levels[i] = level
    first = next((i for i, c in enumerate(word) if c in _VOWELS), len(word))
    return [i for i in range(first + 1, len(word)) if levels[i + 1] % 2]


@functools.lru_cache(maxsize=200_000)
def syllables(word: str) -> int:
    """Syllables of a word, at least 1; parts with hyphens or apostrophes count on their own, short endings (n't, 's) not at all."""
    total = 0
    for part in _SPLIT.split(word):
        plain = _plain(part)
        if any(c in _VOWELS for c in plain):
            total += 1 + len(breaks(plain))
    return max(1, total)
