import pytest
from pyspark.sql import functions as F

from veilspark.functions.text import clean_label_value, letters, strip, two_decimals
from veilspark.operators import detect
from veilspark.operators.rules import RULES

RULE = {r.name: r for r in RULES}


def values(spark, name, text):
    df = spark.createDataFrame([(1, text)], "k int, text string")
    return [r["original"] for r in detect.rule_hits(df, "text", RULE[name]).orderBy("match_ord").collect()]


@pytest.mark.parametrize(
    "name,text,found",
    [
        ("label_project", "项目名称：甲乙工程，其余", ["甲乙工程"]),
        ("label_organization", "承担单位: 为某某、另一家\n", ["某某、另一家"]),
        ("label_person", "项目负责人：王小明五六", ["王小明五"]),
        ("label_amount", "Budget: $ 12.5 USD", ["$ 12.5 USD"]),
        ("id_card", "证件 110101199003078515。", ["110101199003078515"]),
        ("id_card", "证110101199003078515", []),
        ("phone", "电话13812345678", []),
        ("phone", "电话：13812345678,13912345678", ["13812345678", "13912345678"]),
        ("phone", "x𠀀13812345678", []),
        ("email", "a.b@c.example.org。", ["a.b@c.example.org"]),
        ("contract_id", "ht-2024-001、HT-2024-12", ["ht-2024-001"]),
        ("patent_id", "ZL201020304050.7,", ["ZL201020304050.7"]),
        ("software_copyright", "2020SR123456", ["2020SR123456"]),
        ("amount", "1,200万元 a300元 3.5 亿元", ["200万元", "3.5 亿元"]),
        ("technical_metric", "≤　13天 ≥ 5kV", ["≤　13天", "≥ 5kV"]),
        ("address", "广东省广州市天河区某路12号后", ["广东省广州市天河区某路12号"]),
        ("bank_card", "卡 6222021234567890123 尾", ["6222021234567890123"]),
        ("passport", "e1234567 ", ["e1234567"]),
        ("credit_code", "91350211M000100Y43 ", ["91350211M000100Y43"]), ("credit_code", "9135021IM000100Y43 ", []),
        ("credit_code", "911234567890123456", ["911234567890123456"]),
        ("validation_evidence", "已完成试运行三个月。后", ["试运行三个月"]),
    ],
)
def test_rules(spark, name, text, found):
    assert values(spark, name, text) == found


def test_first_occurrence_gives_the_attributes(spark):
    df = spark.createDataFrame([("p", 1, "合同金额：350万元"), ("p", 2, "另有 350万元 与 20万元"), ("q", 1, "计 350万元"), ("q", 2, None), ("q", 3, "")], "project_id string, n int, text string")
    got = {(r["project_id"], r["original"]): r["replacement_hint"] for r in detect.detect(df, ["project_id"], "n", "text").filter("kind = 'amount'").collect()}
    assert got == {("p", "350万元"): None, ("p", "20万元"): "10万至50万", ("q", "350万元"): "100万至500万"}


@pytest.mark.parametrize("value,bucket", [("9.9万元", "低于10万"), ("10万元", "10万至50万"), ("3亿元", "高于5000万"), ("600000元", "50万至100万"), ("$10000", "低于10万"), ("10000000 RMB", "1000万至5000万"), ("75", "50万至100万"), ("无", "金额区间未知"), (None, None), ("５０万元", "50万至100万")])
def test_amount_range(spark, value, bucket):
    assert spark.createDataFrame([(value,)], "v string").select(detect.amount_range(F.col("v"))).first()[0] == bucket


def test_strip_and_clean(spark):
    df = spark.createDataFrame([("　 为 ：甲，。\x1f",), (None,), ("",)], "v string")
    assert [r[0] for r in df.select(strip(F.col("v"))).collect()] == ["为 ：甲，。", None, ""]
    assert [r[0] for r in df.select(clean_label_value(F.col("v"))).collect()] == ["甲", None, ""]


def test_letters(spark):
    want = {1: "A", 26: "Z", 27: "AA", 52: "AZ", 53: "BA", 702: "ZZ", 703: "AAA", 18278: "ZZZ", 18279: "AAAA"}
    df = spark.createDataFrame([(n,) for n in want], "n int")
    assert {r["n"]: r["s"] for r in df.select("n", letters(F.col("n")).alias("s")).collect()} == want


def test_letters_of_any_length(spark):
    def word(n):
        out = ""
        while n:
            n, r = divmod(n - 1, 26)
            out = chr(65 + r) + out
        return out

    want = {n: word(n) for m in range(1, 14) for s in [sum(26**i for i in range(1, m + 1))] for n in (s - 1, s, s + 1)} | {2**63 - 1: word(2**63 - 1), 475254: "ZZZZ", 475255: "AAAAA"}
    df = spark.createDataFrame([(n,) for n in want], "n long")
    assert {r["n"]: r["s"] for r in df.select("n", letters(F.col("n")).alias("s")).collect()} == want
    assert spark.sql("select cast(null as int) n").select(letters(F.col("n"))).first()[0] is None


def test_all_numbers_come_out_as_letters(spark, tmp_path):
    from veilspark.plans import registry

    spark.createDataFrame([(17999,), (18000,), (18001,), (38110,), (1000000,)], "ord int").write.parquet(f"{tmp_path}/entities.parquet")
    got = {r["n"]: r["letters"] for r in registry.queries()["placeholder_letters"](spark, str(tmp_path)).collect()}
    assert got == {18000: "ZPH", 18001: "ZPI", 18002: "ZPJ", 38111: "BDIU", 1000001: "BDWGO"}


def test_body_before_channels(spark):
    cols = "p string, kind string, original string, placeholder_prefix string, strategy string, replacement_hint string"
    body = spark.createDataFrame([("p", "phone", "1", "电话", "mask", None), ("p", "email", "abc", "邮箱", "mask", None)], cols)
    hidden = spark.createDataFrame([("p", 2, "phone", "1", "电话", "mask", None), ("p", 1, "phone", "22", "电话", "mask", None)], "p string, file_ord int, " + cols.split(", ", 1)[1])
    got = [(r["ord"], r["original"]) for r in detect.body_then_channels(body, hidden, ["p"]).orderBy("ord").collect()]
    assert got == [(1, "abc"), (2, "1"), (3, "22")]


def test_empty_tables(spark):
    df = spark.createDataFrame([], "project_id string, n int, text string")
    assert detect.detect(df, ["project_id"], "n", "text").count() == 0


def test_two_decimals(spark):
    values = [i / 1000 for i in range(0, 1001)] + [0.375, 0.125, 0.3649999, 1e-9]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(two_decimals(F.col("v"))).collect()] == [f"{v:.2f}" for v in values]
