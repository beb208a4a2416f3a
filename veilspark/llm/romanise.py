"""Ideographs as simplified forms and as plain syllables, from the transliterators that ship with Spark's ICU; bounded by the script."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import SparkSession

from veilspark.functions.chars import visual_decomposition

#: Characters whose reading in names is confused with that of their look-alike (fixed values).
NAME_READINGS = {"伯": "bai", "佰": "bai", "稯": "ji", "苑": "wan", "埔": "pu"}


def reading_tables(spark: SparkSession) -> tuple[dict[str, str], dict[str, str]]:
    """(simplified form, syllable) of each unified ideograph of the basic block."""
    return _tables(spark.sparkContext.applicationId, spark)


_known: dict[str, tuple[dict[str, str], dict[str, str]]] = {}


def _tables(app: str, spark: SparkSession) -> tuple[dict[str, str], dict[str, str]]:
    if app not in _known:
        chars = [chr(n) for n in range(0x4E00, 0xA000)]
        icu = spark._jvm.com.ibm.icu.text.Transliterator
        run = lambda name, xs: icu.getInstance(name).transliterate("\n".join(xs)).split("\n")
        simple = dict(zip(chars, run("Traditional-Simplified", chars)))
        sound = {c: re.sub("[^a-z]", "", s) for c, s in zip(chars, run("Han-Latin; Latin-ASCII; Lower", chars))}
        _known[app] = ({c: s for c, s in simple.items() if c != s and len(s) == 1}, sound | NAME_READINGS)
    return _known[app]


@lru_cache(maxsize=200_000)
def looks(s: str) -> str:
    """The value as it looks, white space collapsed."""
    out = "".join(map(visual_decomposition, s))
    return re.sub(r"\s+", " ", unicodedata.normalize("NFC", out)).strip()


def is_han(c: str) -> bool:
    return "一" <= c <= "鿿"


def osa(a: str, b: str, most: int = 3) -> int:
    """Edits with transpositions, or more than ``most``; only a band of that width about the diagonal is computed."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    far = most + 1
    before, row = None, {j: j for j in range(min(len(b), most) + 1)}
    for i, x in enumerate(a, 1):
        new = {0: i} if i <= most else {}
        for j in range(max(1, i - most), min(len(b), i + most) + 1):
            y = b[j - 1]
            v = min(row.get(j, far) + 1, new.get(j - 1, far) + 1, row.get(j - 1, far) + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before.get(j - 2, far) + 1)
            new[j] = v
        before, row = row, new
        if min(row.values(), default=far) > most:
            return far
    return row[len(b)]
