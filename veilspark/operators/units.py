"""Quantities in different units: one number in the base unit of its dimension for each stated value.

Everything is an expression of Spark SQL: the number and the unit are extracted by regular expressions, the unit's alias is
looked up in a small fixed table by a broadcast join, the unit comes from the text, else from the remark beside it, else from
the source's default, and factor and offset are applied in decimals, so that equal quantities give equal numbers.

Defined results: a null, empty or unreadable text gives null value and unit, as does a number of more than twelve
digits before or eight behind the point; a bare number without any unit gives a null unit; a
remark may hold a range, a unit or both, in any order; the range is never used. Repeated rows stay repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions.chars import fold_visual, fold_width

#: canonical unit -> (dimension, factor, offset): base = (value + offset) * factor. Temperatures are counted in ninths of a kelvin
#: so that degrees Fahrenheit stay exact. Fixed values of physics and money.
UNITS = {
    "CNY": ("money_cny", "1", "0"), "kCNY": ("money_cny", "1000", "0"), "wCNY": ("money_cny", "10000", "0"), "MCNY": ("money_cny", "1000000", "0"), "eCNY": ("money_cny", "100000000", "0"),
    "USD": ("money_usd", "1", "0"), "kUSD": ("money_usd", "1000", "0"), "wUSD": ("money_usd", "10000", "0"), "MUSD": ("money_usd", "1000000", "0"), "eUSD": ("money_usd", "100000000", "0"),
    "EUR": ("money_eur", "1", "0"), "wEUR": ("money_eur", "10000", "0"), "MEUR": ("money_eur", "1000000", "0"),
    "ppm": ("ratio", "1", "0"), "‰": ("ratio", "1000", "0"), "%": ("ratio", "10000", "0"),
    "s": ("time", "1", "0"), "min": ("time", "60", "0"), "h": ("time", "3600", "0"), "d": ("time", "86400", "0"), "week": ("time", "604800", "0"), "ms": ("time", "0.001", "0"),
    "mV": ("voltage", "0.001", "0"), "V": ("voltage", "1", "0"), "kV": ("voltage", "1000", "0"), "MV": ("voltage", "1000000", "0"),
    "W": ("power", "1", "0"), "kW": ("power", "1000", "0"), "wkW": ("power", "10000000", "0"), "MW": ("power", "1000000", "0"), "GW": ("power", "1000000000", "0"),
    "J": ("energy", "0.001", "0"), "kJ": ("energy", "1", "0"), "MJ": ("energy", "1000", "0"), "GJ": ("energy", "1000000", "0"), "Wh": ("energy", "3.6", "0"), "kWh": ("energy", "3600", "0"), "wkWh": ("energy", "36000000", "0"), "MWh": ("energy", "3600000", "0"), "GWh": ("energy", "3600000000", "0"),
    "Pa": ("pressure", "1", "0"), "kPa": ("pressure", "1000", "0"), "MPa": ("pressure", "1000000", "0"), "bar": ("pressure", "100000", "0"), "mbar": ("pressure", "100", "0"),
    "mg": ("mass", "0.000001", "0"), "g": ("mass", "0.001", "0"), "kg": ("mass", "1", "0"), "jin": ("mass", "0.5", "0"), "liang": ("mass", "0.05", "0"), "t": ("mass", "1000", "0"), "wt": ("mass", "10000000", "0"),
    "um": ("length", "0.000001", "0"), "mm": ("length", "0.001", "0"), "cm": ("length", "0.01", "0"), "dm": ("length", "0.1", "0"), "m": ("length", "1", "0"), "km": ("length", "1000", "0"), "in": ("length", "0.0254", "0"), "ft": ("length", "0.3048", "0"), "li": ("length", "500", "0"),
    "K": ("temperature", "9", "0"), "C": ("temperature", "9", "273.15"), "F": ("temperature", "5", "459.67"),
    "time": ("count", "1", "0"),
}

#: Spellings of each canonical unit, without spaces (fixed values). Case counts, as mW and MW differ; a lower-case reading is tried second.
ALIASES = {
    "CNY": "元 元人民币 人民币元 人民币 RMB CNY 圆 块 yuan", "kCNY": "千元 千元人民币 千人民币 kRMB kCNY thousandRMB thousandCNY", "wCNY": "万元 万元人民币 万人民币 万RMB 万CNY 萬元", "MCNY": "百万元 百万元人民币 百万人民币 MRMB MCNY millionRMB millionCNY", "eCNY": "亿元 亿元人民币 亿人民币 亿 亿RMB 亿CNY",
    "USD": "美元 USD dollars dollar $ US$ 美金", "kUSD": "千美元 kUSD thousandUSD thousanddollars k$", "wUSD": "万美元 万USD", "MUSD": "百万美元 MUSD millionUSD milliondollars", "eUSD": "亿美元 亿USD",
    "EUR": "欧元 EUR €", "wEUR": "万欧元", "MEUR": "百万欧元 MEUR millionEUR",
    "ppm": "ppm PPM", "‰": "‰ 千分之", "%": "% 百分之 percent 个百分点",
    "s": "s 秒 sec 秒钟", "min": "min 分钟 分 mins minutes minute", "h": "h 小时 个小时 hours hour hr 时", "d": "d 天 日 days day", "week": "周 星期 个星期 weeks week w", "ms": "ms 毫秒",
    "mV": "mV 毫伏", "V": "V 伏 伏特", "kV": "kV KV 千伏", "MV": "MV 兆伏",
    "W": "W 瓦 瓦特", "kW": "kW KW 千瓦", "wkW": "万kW 万千瓦", "MW": "MW 兆瓦", "GW": "GW 吉瓦",
    "J": "J 焦 焦耳", "kJ": "kJ 千焦", "MJ": "MJ 兆焦", "GJ": "GJ 吉焦", "Wh": "Wh 瓦时", "kWh": "kWh KWh KWH 度 千瓦时", "wkWh": "万kWh 万度 万千瓦时", "MWh": "MWh 兆瓦时", "GWh": "GWh 吉瓦时",
    "Pa": "Pa 帕 帕斯卡", "kPa": "kPa KPa 千帕", "MPa": "MPa 兆帕", "bar": "bar 巴", "mbar": "mbar 毫巴",
    "mg": "mg 毫克", "g": "g 克", "kg": "kg KG Kg 公斤 千克", "jin": "斤 市斤", "liang": "两 市两", "t": "t 吨 公吨", "wt": "万吨",
    "um": "um μm µm 微米", "mm": "mm 毫米", "cm": "cm 厘米", "dm": "dm 分米", "m": "m 米", "km": "km 千米 公里", "in": "in 英寸 inch inches", "ft": "ft 英尺", "li": "里 市里",
    "K": "K 开 开尔文", "C": "℃ °C 摄氏度", "F": "℉ °F 华氏度",
    "time": "次 times",
}

UPPER = "≤ <= < ⩽ 不大于 不高于 不超过 不多于 至多 最多 最大 小于等于 低于 少于 atmost nomorethan upto".split()
LOWER = "≥ >= > ⩾ 不低于 不小于 不少于 至少 最少 最小 大于等于 高于 多于 atleast nolessthan".split()
_HAN_DIGITS = "零〇一二两三四五六七八九"
_NUMBER = r"[+-]?\d+(?:\.\d+)?"
#: Ten thousands and hundred millions belong to the numeral where more of it follows, else to the unit.
_HAN_NUMBER = r"(?:[零〇一二两三四五六七八九十百千]+[万亿](?=[零〇一二两三四五六七八九十百千]))*[零〇一二两三四五六七八九十百千]+"


def alias_rows() -> list[tuple[str, str, str, str, str]]:
    """(alias, unit, dimension, factor, offset); a fixed table of less than three hundred rows."""
    return [(a, u, *UNITS[u]) for u, names in ALIASES.items() for a in names.split()]


def all_aliases() -> list[tuple[str, str, str, str, str]]:
    """The aliases and, where no other unit is spelt so, their lower-case readings."""
    rows = alias_rows()
    seen = {r[0] for r in rows}
    return rows + [(low, *r[1:]) for r in rows if (low := r[0].lower()) not in seen and not seen.add(low)]


def alias_table(spark: SparkSession) -> DataFrame:
    d = F.col
    return spark.createDataFrame(all_aliases(), "alias string, unit string, dimension string, factor_s string, offset_s string").select(
        "alias", "unit", "dimension", d("factor_s").cast("decimal(16,6)").alias("factor"), d("offset_s").cast("decimal(10,2)").alias("offset")
    )


def han_number(c: Column) -> Column:
    """The value of a Chinese numeral, as in 四百八十一 or 十二万三千; plain digit runs as in 二〇一 are read digit by digit. Null where it is
    not well formed: sections of more signs than a numeral has, or ten thousands before hundred millions."""
    digit = lambda x: F.when(x == "〇", 0).when(x == "两", 2).otherwise(F.instr(F.lit("零一二三四五六七八九"), x) - 1)
    big = lambda x: x.cast("bigint")
    state = lambda high, total, last: F.struct(big(high).alias("high"), big(total).alias("total"), big(last).alias("last"))
    below = lambda a: a["total"] + F.greatest(a["last"], F.lit(0))

    def step(a: Column, x: Column) -> Column:
        power = F.when(x == "十", 10).when(x == "百", 100).when(x == "千", 1000)
        grown = state(a["high"], a["total"] + F.when(a["last"] < 0, F.lit(1)).otherwise(a["last"]) * power, F.lit(-1))
        read = state(a["high"], a["total"], F.when(a["last"] > 0, a["last"] * 10).otherwise(F.lit(0)) + digit(x))
        ten_thousands = state(a["high"] + below(a) * 10_000, F.lit(0), F.lit(-1))
        hundred_millions = state((a["high"] + below(a)) * 100_000_000, F.lit(0), F.lit(-1))
        return F.when(x == "万", ten_thousands).when(x == "亿", hundred_millions).when(power.isNotNull(), grown).otherwise(read)

    value = F.aggregate(F.split(c, ""), state(F.lit(0), F.lit(0), F.lit(-1)), lambda a, x: F.when(x == "", a).otherwise(step(a, x)), lambda a: a["high"] + below(a))
    return F.when(c.rlike("^(?:[^万亿]{1,8}亿)?(?:[^万亿]{1,8}万)?[^万亿]{1,12}$"), value)


def _bound(c: Column) -> Column:
    low = F.lower(c)
    starts = lambda words: F.lit(False) if not words else low.rlike("^(?:" + "|".join(words) + ")")
    return F.when(starts(UPPER), "at_most").when(starts(LOWER), "at_least").otherwise("none")


def normalize_quantities(df: DataFrame, text: str, hint: str | None = None, default_unit: str | None = None) -> DataFrame:
    """Adds q_value decimal(38,14) (base unit, exact), q_dimension, q_unit, q_number decimal (as stated) and q_bound to each row.

    The unit is that in the text, else that in ``hint``, else ``default_unit``, a column name or null."""
    spark = df.sparkSession
    clean = F.regexp_replace(F.regexp_replace(fold_width(fold_visual(F.col(text))), r"\s+", ""), r"(\d),(?=\d)", "$1")
    words = "|".join(UPPER + LOWER)
    body = F.regexp_replace(F.col("_q"), f"(?i)^(?:{words})", "")
    lead = r"^(US\$|\$|€|[A-Z]{3}|百分之|千分之|人民币)?"
    x = df.withColumn("_q", clean).withColumn("_b", body)
    x = (
        x.withColumn("_digits", F.regexp_extract("_b", lead + f"({_NUMBER})(.*)$", 2))
        .withColumn("_han", F.regexp_extract("_b", lead + f"({_HAN_NUMBER})(.*)$", 2))
        .withColumn("_lead", F.coalesce(F.nullif(F.regexp_extract("_b", lead + f"({_NUMBER}|{_HAN_NUMBER})(.*)$", 1), F.lit("")), F.lit("")))
        .withColumn("_rest", F.regexp_extract("_b", lead + f"({_NUMBER}|{_HAN_NUMBER})(.*)$", 3))
        .withColumn("q_number", F.when((F.col("_digits") != "") & F.col("_digits").rlike(r"\.\d{8}\d*[1-9]"), None).when(F.col("_digits") != "", F.expr("try_cast(_digits as decimal(20,8))")).when(F.col("_han") != "", han_number(F.col("_han")).try_cast("decimal(20,8)")))
        .withColumn("q_bound", _bound(F.col("_q")))
        .withColumn("_own", F.coalesce(F.nullif(F.col("_rest"), F.lit("")), F.nullif(F.col("_lead"), F.lit(""))))
    )
    if hint is not None:
        h = fold_width(fold_visual(F.col(hint)))
        named = F.regexp_extract(h, r"(?:原表单位为|单位[:为是]|unit[:=]|以(?=[^;]*计))\s*([^;,]+)", 1)
        plain = F.regexp_extract(h, r"(?:^|;)\s*\(?(?:in\s)?\s*([^;()]+?)\s*\)?\s*$", 1)
        unit = F.regexp_replace(F.when(named != "", F.regexp_replace(F.trim(named), "计$", "")).otherwise(plain), r"\s+", "")
        x = x.withColumn("_hint", F.nullif(unit, F.lit("")))
    else:
        x = x.withColumn("_hint", F.lit(None).cast("string"))
    x = x.withColumn("_said", F.coalesce("_own", "_hint", F.col(default_unit) if default_unit else F.lit(None).cast("string")))
    t = F.broadcast(alias_table(spark).select(*[F.col(c).alias(f"_{c}") for c in ("alias", "unit", "dimension", "factor", "offset")]))
    x = x.join(t, F.col("_said") == F.col("_alias"), "left")
    value = ((F.col("q_number") + F.col("_offset")) * F.col("_factor"))
    keep = [F.col(f"`{c}`") for c in df.columns]
    return x.select(*keep, "q_number", value.alias("q_value"), F.col("_dimension").alias("q_dimension"), F.col("_unit").alias("q_unit"), "q_bound")


def same_quantity_pairs(df: DataFrame, key: str, scope: list[str], text: str, hint: str | None = None) -> DataFrame:
    """Pairs (entity_a < entity_b) within ``scope`` that state one quantity, with one bound, in different units or scales.

    Redelivered rows count once. Rows are aggregated to one set of keys for each (scope, quantity, unit) before the join, so a hot scope is
    joined on its quantities; only pairs that are asked for are formed."""
    q = normalize_quantities(df.select(key, *scope, text, *([hint] if hint else [])), text, hint)
    q = q.filter("q_value is not null and q_unit is not null").select(F.col(key).alias("k"), *scope, "q_value", "q_dimension", "q_bound", "q_unit").distinct()
    on = [*scope, "q_value", "q_dimension", "q_bound"]
    several = q.groupBy(*on).agg(F.min("q_unit").alias("u0"), F.max("q_unit").alias("u1")).filter("u0 <> u1").select(*on)
    q = q.join(several, on, "left_semi")
    a, b = q.withColumnsRenamed({"k": "entity_a", "q_unit": "ua"}), q.withColumnsRenamed({"k": "entity_b", "q_unit": "ub"})
    return a.join(b, on).filter("entity_a < entity_b and ua <> ub").select("entity_a", "entity_b").distinct()
