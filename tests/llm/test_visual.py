import re
import unicodedata

import pytest

from veilspark.functions.chars import code_points, decomposition_rows, visual_decomposition
from veilspark.llm.visual import STABLE, one_form, same_looks


def plain(s):
    s = unicodedata.normalize("NFC", "".join(" " if c in "\t\n\r\x0b\x0c" else visual_decomposition(c) for c in s))
    return re.sub(r"\s+", " ", s).strip(" ")


TEXTS = ["Ａｂｃ　１２", "café café", "ậ ậ", "q̣̇", "a​b﻿­c", "Хаｒоm", "⽔⼯", "ﬁne ㎸ ①", "  x  y \n", "０0Oo1lI", "", "​", "x" * 5000 + "́", "é́̂", "𝐀𝑏", "ｶﾞ", "a\u0323\u0302\u0301\u0300", "e\u0316\u0301\u0302", "o\u0338\u0328\u0304\u0301", "q\u0307\u0323\u0301"]


@pytest.mark.parametrize("i", range(len(TEXTS)))
def test_form(spark, i):
    df = spark.createDataFrame([(1, TEXTS[i]), (2, None)], "k int, t string")
    got = {r["k"]: r["form"] for r in one_form(df, ["k"], "t").collect()}
    assert got == {1: plain(TEXTS[i]), 2: None}


def test_stable_characters_do_not_change():
    changed = {c for c, _ in decomposition_rows()}
    rule = re.compile(f"[{STABLE}]")
    for n in [*range(0x20, 0x7F), *code_points()]:
        c = chr(n)
        if rule.match(c):
            assert c not in changed and not unicodedata.combining(c)


def test_pairs(spark):
    rows = [(1, "p", "ABC"), (2, "p", "АВС"), (3, "p", "ABC"), (2, "p", "АВС"), (4, "q", "ＡＢＣ"), (5, "p", "abc"), (6, "p", None), (7, "p", ""), (8, "p", "​"), (9, None, "x y"), (10, None, "x y"), (11, "p", "0"), (12, "p", "O")]
    got = sorted(tuple(r) for r in same_looks(spark.createDataFrame(rows, "k int, s string, t string"), "k", ["s"], "t").collect())
    assert got == [(1, 2), (2, 3), (9, 10)]


def test_empty(spark):
    assert same_looks(spark.createDataFrame([], "k int, s string, t string, raw string, form string"), "k", ["s"], "t").count() == 0


def test_forms_of_both_fields(spark, tmp_path):
    from veilspark.llm.registry import queries

    spark.createDataFrame([(1, "ＡＢ"), (1, "ＡＢ"), (2, None), (3, "Хаｒоm")], "entity_id long, original string").write.parquet(f"{tmp_path}/entities.parquet")
    spark.createDataFrame([(1, "АВ"), (2, ""), (3, "甲　乙"), (3, "甲　乙"), (4, None), (5, "é"), (5, "x")], "block_key long, text string").write.parquet(f"{tmp_path}/redacted_text_blocks.parquet")
    got = sorted((r["field"], r["key"], r["form"]) for r in queries()["p1_forms"](spark, str(tmp_path)).collect())
    assert got == [("original", 1, "AB"), ("original", 3, "Xarom"), ("text", 1, "AB"), ("text", 2, ""), ("text", 3, "甲 乙"), ("text", 5, "x"), ("text", 5, "é")]


HIDDEN = ["葛\U000e0100城", "ab\U000e0041\U000e007f", "abe\u200b\u0301", "甲乙e\u2060\U000e01ef\u0301x", "\u200b\U000e0100", "\U0001d173a"]


def test_characters_that_show_nothing_vanish_before_the_cut(spark):
    df = spark.createDataFrame(list(enumerate(HIDDEN)), "k int, t string")
    got = {r["k"]: r["form"] for r in one_form(df, ["k"], "t").collect()}
    assert got == {0: "葛城", 1: "ab", 2: "abé", 3: "甲乙éx", 4: "", 5: "a"} == {i: plain(t) for i, t in enumerate(HIDDEN)}
