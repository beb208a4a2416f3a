"""What single characters look like: tables built by rule from the Unicode database, and column functions on them."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters of other scripts that are drawn like an ASCII letter (fixed values).
LOOKALIKES = {
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C",
    "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "Ԍ": "G", "Ѵ": "V", "а": "a", "е": "e", "о": "o", "р": "p",
    "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ү": "y",
    "ӏ": "l", "Ӏ": "I", "ց": "g",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ι": "i", "ϳ": "j", "α": "a", "ρ": "p", "κ": "k", "υ": "u", "τ": "t", "γ": "y",
    "η": "n", "Ϲ": "C", "ϲ": "c", "Ϻ": "M", "Ϝ": "F",
    # Armenian and Latin letters outside ASCII
    "օ": "o", "ո": "n", "ս": "u", "հ": "h", "Տ": "S", "Օ": "O", "ɡ": "g", "ɑ": "a", "ı": "i", "ȷ": "j", "ʋ": "v",
}

#: Characters that show nothing, besides those of the categories Cf and Cc (fixed ranges of the default-ignorable property).
_SHOW_NOTHING = [(0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF)]

#: A Java and RE2 class of the same characters in the basic plane.
INVISIBLE_CLASS = r"[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ]"
#: A Java class of all of them.
ALL_INVISIBLE_CLASS = "[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in _SHOW_NOTHING) + "]"
SPACE_CLASS = r"[\s\u0085   -     　]"


def shows_nothing(c: str) -> bool:
    n = ord(c)
    return any(a <= n <= b for a, b in _SHOW_NOTHING)


def is_space(c: str) -> bool:
    return c.isspace() or unicodedata.category(c) in ("Zs", "Zl", "Zp")


@lru_cache(maxsize=None)
def visual_decomposition(c: str) -> str:
    """The characters that ``c`` looks like: nothing, one space, or its compatibility decomposition with look-alikes replaced."""
    if shows_nothing(c):
        return ""
    if is_space(c):
        return " "
    out = []
    for d in unicodedata.normalize("NFKD", c):
        if shows_nothing(d):
            continue
        out.append(" " if is_space(d) else LOOKALIKES.get(d, d))
    return "".join(out)


def code_points() -> list[int]:
    return [*range(0x80, 0x30000), *range(0xE0000, 0xE1000)]


@lru_cache(maxsize=1)
def decomposition_rows() -> list[tuple[str, str]]:
    """(character, what it looks like) for each assigned character that changes. Bounded by Unicode."""
    rows = []
    for n in code_points():
        if 0xD800 <= n <= 0xDFFF or 0xE000 <= n <= 0xF8FF:
            continue
        c = chr(n)
        if (d := visual_decomposition(c)) != c:
            rows.append((c, d))
    rows += [(chr(n), " ") for n in (9, 10, 11, 12, 13)]
    return rows


@lru_cache(maxsize=1)
def one_to_one() -> tuple[str, str]:
    """Arguments for translate(): characters that look like one other character of the basic plane, without regard to neighbours."""
    a, b = [], []
    for c, d in decomposition_rows():
        if len(d) == 1 and ord(c) < 0x10000 and ord(d) < 0x10000 and not unicodedata.combining(d) and c not in "\t\n\r\x0b\x0c":
            a.append(c)
            b.append(d)
    return "".join(a), "".join(b)


@lru_cache(maxsize=1)
def width_pairs() -> tuple[str, str]:
    """Arguments for translate() of ``fold_width``."""
    wide = "".join(chr(n) for n in range(0xFF01, 0xFF5F))
    ascii_ = "".join(chr(n - 0xFEE0) for n in range(0xFF01, 0xFF5F))
    spaces = "\u00a0\u1680" + "".join(chr(n) for n in range(0x2000, 0x200B)) + "\u202f\u205f\u3000"
    return wide + spaces + "".join(LOOKALIKES) + "\u2011\u2010", ascii_ + " " * len(spaces) + "".join(LOOKALIKES.values()) + "--"


def fold_width(c: Column) -> Column:
    """Full-width ASCII forms, the ideographic space, look-alike letters and a few unit signs as ASCII; characters that show nothing vanish.

    Null stays null; an empty text stays empty."""
    return F.translate(F.regexp_replace(c, INVISIBLE_CLASS, ""), *width_pairs())


def fold_visual(c: Column) -> Column:
    """``fold_width`` plus every other one-to-one look-alike (radicals, compatibility ideographs) in one translate pass."""
    a, b = one_to_one()
    return F.translate(F.regexp_replace(c, INVISIBLE_CLASS, ""), a + "\u2010", b + "-")
