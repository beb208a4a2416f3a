from decimal import Decimal

import pytest

from veilspark.operators.units import alias_rows, normalize_quantities, same_quantity_pairs

SCHEMA = "entity_id long, project_id string, kind string, original string, replacement_hint string"


def one(spark, original, hint=None):
    r = normalize_quantities(spark.createDataFrame([(1, "p", "amount", original, hint)], SCHEMA), "original", "replacement_hint").first()
    return r["q_value"], r["q_dimension"], r["q_unit"], r["q_bound"]


@pytest.mark.parametrize(
    "a,b",
    [(("1.2万元", None), ("12,000元", None)), (("２.５ ＭＷ", None), ("2500千瓦", None)), (("百分之1.3", None), ("13‰", None)), (("0", "单位：℃"), ("273.15K", None)), (("509华氏度", None), ("265 ℃", None)), (("70斤", None), ("35000g", None)), (("3天", None), ("72个小时", None)), (("二十三万元", None), ("0.23百万元", None)), (("5,400", "高于5000万；原表单位为千元"), ("5.4百万元", None)), (("1​0 0kUSD", None), ("$100000", None)), (("460 kPa", None), ("0.46ＭРа", None)), (("5 kWh", None), ("18 MJ", None)), (("100 in", None), ("2.54m", None)), (("0.0005 g", None), ("0.5 mg", None)), (("-10℃", None), ("14℉", None))],
)
def test_equal_quantities(spark, a, b):
    x, y = one(spark, *a), one(spark, *b)
    assert x[0] is not None and x[0] == y[0] and x[1] == y[1] and x[2] != y[2]


@pytest.mark.parametrize("a,b", [("5 kV", "5千伏"), ("3度", "3 kWh"), ("2元", "2 RMB"), ("2 CNY", "2元人民币"), ("1M USD", "1 million USD")])
def test_other_spellings_are_one_unit(spark, a, b):
    assert one(spark, a) == one(spark, b)


def test_bounds_and_missing_units(spark):
    assert one(spark, "≤5.5 kg")[3] == "at_most" and one(spark, "不大于5.5kg")[3] == "at_most"
    assert one(spark, ">=5.5kg")[3] == "at_least" and one(spark, "不低于5.5kg")[3] == "at_least"
    assert one(spark, "5.5kg")[3] == "none"
    assert one(spark, "430")[:3] == (None, None, None)
    assert one(spark, "430", "高于5000万")[2] is None
    assert one(spark, None)[0] is None and one(spark, "")[0] is None and one(spark, "无")[0] is None
    assert one(spark, "430", "（万元）")[0] == Decimal("4300000")
    assert one(spark, "3元", "单位：万元")[2] == "CNY"  # the text's own unit counts


def test_pairs(spark):
    rows = [(1, "p", "amount", "1万元", None), (1, "p", "amount", "1万元", None), (2, "p", "amount", "10000元", None), (3, "p", "amount", "10000 RMB", None), (4, "q", "amount", "10000元", None), (5, "p", "technical_metric", "≤1 kV", None), (6, "p", "technical_metric", "≤1000 V", None), (7, "p", "technical_metric", "1000 V", None), (8, "p", "amount", "$10000", None), (9, None, "amount", "10000元", None)]
    got = sorted(tuple(r) for r in same_quantity_pairs(spark.createDataFrame(rows, SCHEMA), "entity_id", ["project_id", "kind"], "original", "replacement_hint").collect())
    assert got == [(1, 2), (1, 3), (5, 6)]


def test_long_numerals(spark):
    for text, want in (("十二万三千元", 123_000), ("一亿二千三百万零五元", 123_000_005), ("三万元", 30_000), ("二十万元", 200_000), ("两千零一元", 2001), ("二〇一元", 201)):
        assert one(spark, text)[0] == want, text
    for text in ("九" * 40 + "元", "九亿" * 9 + "一元", "一万一亿一元", "9" * 60 + "元", "0." + "1" * 40 + "元"):
        assert one(spark, text)[0] is None, text


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert same_quantity_pairs(df, "entity_id", ["project_id"], "original", "replacement_hint").count() == 0
    extra = spark.createDataFrame([(1, "3 kV", "x", "y")], "k long, original string, unit string, alias string")
    assert normalize_quantities(extra, "original").first()["q_unit"] == "kV"


def test_alias_table_is_bounded():
    rows = alias_rows()
    assert len(rows) < 300 and len({r[0] for r in rows}) == len(rows)
