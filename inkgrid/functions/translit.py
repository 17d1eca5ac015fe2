"""Text in plain letters: other scripts are written in ASCII, a character as none, one or several, in JVM functions.

The tables are made by rule from the names and decompositions that Unicode gives its characters.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters whose names don't say how they are written, and signs.
LATIN_LETTERS = {"sharp s": "ss", "ae": "ae", "eth": "d", "thorn": "th", "dotless i": "i", "eng": "ng", "kra": "q", "oe": "oe", "ij": "ij"}
CYRILLIC_LETTERS = {"ghe": "g", "ha": "kh", "ie": "e", "short i": "y", "yeru": "y", "hard sign": "", "soft sign": "", "byelorussian-ukrainian i": "i", "ukrainian ie": "ye", "straight u": "u"}
GREEK_LETTERS = {
    "alpha": "a", "beta": "b", "gamma": "g", "delta": "d", "epsilon": "e", "zeta": "z", "eta": "i", "theta": "th", "iota": "i", "kappa": "k", "lamda": "l", "mu": "m",
    "nu": "n", "xi": "x", "omicron": "o", "pi": "p", "rho": "r", "sigma": "s", "final sigma": "s", "tau": "t", "upsilon": "u", "phi": "f", "chi": "ch", "psi": "ps", "omega": "o",
}
SIGNS = {"'": "‘’‚‛′ʼ", ".": "·", '"': "“”„‟«»″", "-": "‐‑‒–—―−", "/": "⁄"}
# The parts of Hangul syllables, as their names spell them.
INITIALS = "g gg n d dd r m b bb s ss  j jj c k t p h".split(" ")
MEDIALS = "a ae ya yae eo e yeo ye o wa wae oe yo u weo we wi yu eu yi i".split(" ")
FINALS = " g gg gs n nj nh d l lg lm lb ls lt lp lh m b bs s ss ng j c k t p h".split(" ")
#: Ranges of characters that have tables: Latin, Greek and Cyrillic with marks; more Latin; signs.
RANGES = ((0x80, 0x530), (0x1E00, 0x1F00), (0x2000, 0x2070))


def _letter(script: str, name: str) -> str | None:
    """How a letter is written, by its name: A is a, BE is b, EL is l, SHCHA is shch, YU is yu."""
    name = name.lower()
    special = {"latin": LATIN_LETTERS, "cyrillic": CYRILLIC_LETTERS, "greek": GREEK_LETTERS}[script]
    if name in special:
        return special[name]
    if len(name) == 1 or re.fullmatch("y?[aeiou]", name):
        return name
    if script == "cyrillic" and (m := re.fullmatch("e([^aeiou ]+)|([^aeiou ]+)[aeiou]", name)):
        return m[1] or m[2]
    return None


def plain_character(c: str) -> str:
    """c in ASCII; itself where no rule says how."""
    if c.isascii():
        return c
    if unicodedata.combining(c):
        return ""
    for sign, kinds in SIGNS.items():
        if c in kinds:
            return sign
    parts = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
    if parts and parts != c:
        return "".join(map(plain_character, parts))
    name = re.fullmatch(r"(LATIN|CYRILLIC|GREEK) (?:SMALL|CAPITAL) (?:LETTER|LIGATURE) (.+?)(?: WITH .*)?", unicodedata.name(c, ""))
    found = _letter(name[1].lower(), name[2]) if name else None
    return c if found is None else found


def plain(text: Column) -> Column:
    """text in lower case and plain letters; null stays null."""
    low = F.lower(text)
    code = F.ascii  # of the first character, by its code point

    def one(c: Column) -> Column:
        n = code(c)
        out = F.when(n < 128, c)
        for first, last in RANGES:
            table = F.split(F.lit("\n".join(plain_character(chr(k)).lower() for k in range(first, last))), "\n")
            out = out.when((n >= first) & (n < last), F.element_at(table, n - first + 1))
        s = n - 0xAC00
        part = lambda names, at: F.element_at(F.split(F.lit("\n".join(names)), "\n"), at.cast("int") + 1)
        syllable = F.concat(part(INITIALS, F.floor(s / 588)), part(MEDIALS, F.floor((s % 588) / 28)), part(FINALS, s % 28))
        out = out.when((n >= 0xAC00) & (n < 0xD7A4), syllable)
        return out.when((n > 0xFF00) & (n < 0xFF5F), F.lower(F.char(n - 0xFEE0))).otherwise(c)

    return F.when(low.rlike(r"[^\x00-\x7f]"), F.array_join(F.transform(F.split(low, ""), one), "")).otherwise(low)
