"""Column functions with the text semantics of the operators: stripping, lettering, identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space in the sense of Unicode, spelt out so that every engine reads the same class.
SPACE = "\t-\r\x1c- \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_DIGITS = "".join(chr(0xFF10 + i) for i in range(10))


def strip(c: Column) -> Column:
    """Without white space at either end; null stays null."""
    return F.regexp_replace(c, f"^[{SPACE}]+|[{SPACE}]+$", "")


def clean_label_value(c: Column) -> Column:
    """A labelled value without the copula and punctuation around it."""
    return F.regexp_replace(F.regexp_replace(strip(c), f"^(?:为|是)[{SPACE}]*", ""), "^[ ：:，,。；;]+|[ ：:，,。；;]+$", "")


def letters(n: Column) -> Column:
    """1 -> A, 26 -> Z, 27 -> AA: bijective base 26, for every positive bigint."""
    k, most = n.cast("bigint") - 1, 14
    first = [sum(26**i for i in range(1, m)) for m in range(1, most + 1)]  # k of the first number with m letters
    with_letters = lambda m: F.translate(F.lpad(F.conv((k - first[m - 1]).cast("string"), 10, 26), m, "0"), "0123456789ABCDEFGHIJKLMNOP", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    out = F.when(k < first[1], with_letters(1))
    for m in range(2, most):
        out = out.when(k < first[m], with_letters(m))
    return out.otherwise(with_letters(most))


def candidate_id(kind: Column, original: Column) -> Column:
    """The public identifier of a private value."""
    return F.substring(F.sha2(F.concat(kind, F.lit("|"), original), 256), 1, 16)


def ascii_digits(c: Column) -> Column:
    return F.translate(c, _DIGITS, "0123456789")


def two_decimals(x: Column) -> Column:
    """A small double with two decimals, rounded by its exact binary value, ties to even; the formatter rounds its shortest decimal instead."""
    p = x * 100
    f = F.floor(p)
    split = x * F.lit(134217729.0)
    high = split - (split - x)
    error = (high * 100 - p) + (x - high) * 100  # what the product lost, exactly
    tie = (p - f) == 0.5
    return F.format_string("%.2f", F.when(tie & (error < 0), f.cast("double")).when(tie & (error > 0), f + 1.0).otherwise(F.rint(p)) / 100)
