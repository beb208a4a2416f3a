"""Which address records denote the same place.

Each record is read into number, street, kind of way, town and, where they stand, district and province; ideographs are read as syllables
so that romanised records and misspelt homophones meet. Distinct readings are banded by MinHash over the q-grams and tokens of street and town,
two rows a band, with the number token in each; candidates are verified by an affine-gap alignment of their tokens, whose substitutions know the
abbreviations of ways and cost edits otherwise. Records of one reading are classed before banding, so copies are not compared.

Defined results: records without key, and null, empty and unreadable ones (without number, street or town) match nothing; floors, rooms, buildings, postcodes,
landmarks, order, case and width do not matter; a missing district or province matches any; repeated rows count once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.romanise import is_han, looks, osa, reading_tables
from veilspark.session import cut

#: Abbreviations of ways (fixed values); the first of each row names the kind.
WAYS = ["street st str 街", "road rd 路", "avenue ave av aven 大道", "lane ln la 巷", "drive dr drv", "court ct crt", "terrace ter terr tce", "square sq sqr", "close cl", "crescent cres", "boulevard blvd", "way wy", "place pl", "gardens gdns"]
KIND = {a: row.split()[0] for row in WAYS for a in row.split()}
PROVINCES = "北京 天津 上海 重庆 河北 山西 辽宁 吉林 黑龙江 江苏 浙江 安徽 福建 江西 山东 河南 湖北 湖南 广东 海南 四川 贵州 云南 陕西 甘肃 青海 台湾 内蒙古 广西 西藏 宁夏 新疆 香港 澳门".split()
_ROMAN_PROVINCES = set("beijing tianjin shanghai chongqing hebei shanxi liaoning jilin heilongjiang jiangsu zhejiang anhui fujian jiangxi shandong henan hubei hunan guangdong hainan sichuan guizhou yunnan shaanxi gansu qinghai taiwan guangxi ningxia xinjiang tibet".split())
GAP_OPEN, GAP_EXTEND, ACCEPT = 0.7, 0.35, 0.75
BANDS, ROWS, GRAM = 24, 2, 3
#: Letters from which a token is long.
LONG = 40

_HAN_NUM = {c: i for i, c in enumerate("零一二三四五六七八九")} | {"〇": 0, "两": 2}
_ZH_STREET = re.compile(r"([一-鿿]+?)(大道|路|街|巷)\s?(?:门牌)?\s?(\d{1,5}|[零〇一二两三四五六七八九十百千]+)(?:\s?[号號#])?")
_UNIT = re.compile(r"\b(?:flat|apt|apartment|suite|ste|unit|room|rm)\.?\s*#?\s*\d*[a-z]?\b|\b\d+(?:st|nd|rd|th) floor\b|\bfloor \d+\b")
_POST = re.compile(r"\b[a-z]{1,2}\d{1,2}[a-z]? \d[a-z]{2}\b|\b\d{6}\b")
_NUM = re.compile(r"(?:\bno\.?\s*|#\s*)?\b(\d{1,5})\b")
_EN_WAY = re.compile(r"\b(" + "|".join(sorted((a for a in KIND if a.isascii()), key=len, reverse=True)) + r")\b\.?")


def han_value(s: str) -> int:
    if s.isdigit():
        return int(s)
    total, last = 0, -1
    for c in s:
        p = {"十": 10, "百": 100, "千": 1000}.get(c)
        if p:
            total, last = total + (1 if last < 0 else last) * p, -1
        else:
            last = max(last, 0) * 10 + _HAN_NUM[c]
    return total + max(last, 0)


class Reader:
    """Reads one record into (number, street, kind of way, town, district, province, script); None where that fails."""

    def __init__(self, simple: dict[str, str], sound: dict[str, str]):
        self.simple, self.sound = simple, sound

    def say(self, s: str) -> str:
        return "".join(self.sound.get(c, c) for c in s if is_han(c))

    def read(self, value: str | None) -> tuple | None:
        if not value or not value.strip():
            return None
        s = looks(value)
        return self._han(s) if sum(map(is_han, s)) >= 4 else self._latin(s.lower())

    def _han(self, s: str) -> tuple | None:
        s = "".join(self.simple.get(c, c) for c in s)
        s = re.sub(r"[（(][^（）()]*[)）]", "", re.sub(r"^\d{6}\s*", "", s))
        m = None
        for m in _ZH_STREET.finditer(s):
            break
        if m is None:
            return None
        before, name, way, number = s[: m.start()], m[1], KIND[m[2]], han_value(m[3])
        after = [p for p in re.split(r"[，,、]\s*", s[m.end() :])[1:] if p]
        province = district = town = None
        if after:  # from small to large
            for p in reversed(after):
                p = re.sub(r"[^一-鿿]", "", p)
                if province is None and any(p == x or p[:-1] == x for x in PROVINCES) and town is None:
                    province = next(x for x in PROVINCES if p.startswith(x))
                elif town is None:
                    town = re.sub("市$", "", p)
                elif district is None:
                    district = re.sub("[区县]$", "", p)
        else:
            rest = re.sub(r"[^一-鿿]", " ", before + name)
            rest = re.sub(r"(?<=[一-鿿]) (?=[市区省])", "", rest)
            for x in PROVINCES:
                if (t := rest.lstrip()).startswith(x):
                    province, rest = x, re.sub("^(?:省|市|自治区)", "", t[len(x) :])
                    break
            if (c := re.match(r"\s*([一-鿿]{2,3}?)市(.*)$", rest)) is not None:
                town, rest = c[1], c[2]
            if (c := re.match(r"\s*([一-鿿]{2,5}?)[区县](.*)$", rest)) is not None and len(c[2].strip()) >= 1:
                d = c[1]
                rest = c[2]
                district = d
            parts = [re.sub("(?<=..)[区县市]$", "", x) for x in rest.split()]
            if town is None and len(parts) > 1:
                town, parts = parts[0], parts[1:]
            if district is None and len(parts) > 1:
                district, parts = parts[0], parts[1:]
            word = "".join(parts)
            if town is None and district is not None:  # no word for the town: it stands before the district, in one run
                town, district = (district[:2], district[2:]) if len(district) >= 4 else (district, None)
            elif town is None and len(word) >= 4:
                town, word = word[:2], word[2:]
            if district is None and len(word) >= 4:
                district, word = word[:-2], word[-2:]
            name = word
        if not name or not town:
            return None
        return (number, self.say(name), way, self.say(town), self.say(district) if district else None, self._province(province), "han")

    def _province(self, p: str | None) -> str | None:
        if not p:
            return None
        return "shaanxi" if p == "陕西" else self.say(p)

    def _latin(self, s: str) -> tuple | None:
        s = _POST.sub(" ", _UNIT.sub(" ", s))
        m = _NUM.search(s)
        if m is None:
            return None
        number = int(m[1])
        s = s[: m.start()] + " " + s[m.end() :]
        parts = [" ".join(p.replace("'", "").split()) for p in re.split(r"[,;]", s)]
        parts = [p for p in parts if re.search("[a-z]", p)]
        at = next((i for i, p in enumerate(parts) if list(_EN_WAY.finditer(p)) and _EN_WAY.search(p).start() > 0), None)
        if at is None:
            return None
        w = [x for x in _EN_WAY.finditer(parts[at]) if x.start() > 0][-1]
        street, way, tail = parts[at][: w.start()].strip(), KIND[w[1]], parts[at][w.end() :].strip(" .")
        others = [p for p in [*parts[:at], tail, *parts[at + 1 :]] if p]
        province = district = town = None
        for p in others:
            if p.endswith(" district"):
                district = p[:-9].replace(" ", "")
            elif p.endswith(" province") or p in _ROMAN_PROVINCES:
                province = p.removesuffix(" province").replace(" ", "")
            elif p.endswith(" city"):
                town = p[:-5].replace(" ", "")
            elif town is None:
                town = p.replace(" ", "")
        clean = lambda x: re.sub("[^a-z]", "", x) if x else None
        if not town or not street:
            return None
        return (number, clean(street), way, clean(town), clean(district), clean(province), "han" if district or province else "latin")


def word_cost(a: str, b: str, syllables: bool) -> float:
    """Cost of one token for another: nothing for equal ones or abbreviations of one way, else its edits. A character mistaken for one that
    looks alike may change a syllable by two letters."""
    if a == b or KIND.get(a, a) == KIND.get(b, b):
        return 0.0
    if a in KIND or b in KIND:
        return 2.0
    d, n = osa(a, b, 2), min(len(a), len(b))
    return 0.3 if d == 1 and n >= 4 else 0.6 if d == 2 and n >= 5 and syllables else 2.0


def align(a: list[str], b: list[str], syllables: bool = False) -> float:
    """Least cost of an affine-gap alignment of two token lists."""
    inf, n, m = float("inf"), len(a), len(b)
    match = np.full((n + 1, m + 1), inf)
    ga, gb = match.copy(), match.copy()
    match[0, 0] = 0.0
    for i in range(n + 1):
        for j in range(m + 1):
            if i and j:
                match[i, j] = min(match[i - 1, j - 1], ga[i - 1, j - 1], gb[i - 1, j - 1]) + word_cost(a[i - 1], b[j - 1], syllables)
            if i:
                ga[i, j] = min(match[i - 1, j] + GAP_OPEN, ga[i - 1, j] + GAP_EXTEND, gb[i - 1, j] + GAP_OPEN)
            if j:
                gb[i, j] = min(match[i, j - 1] + GAP_OPEN, gb[i, j - 1] + GAP_EXTEND, ga[i, j - 1] + GAP_OPEN)
    return float(min(match[n, m], ga[n, m], gb[n, m]))


def same_place(x: tuple, y: tuple) -> bool:
    """Whether two readings of one number denote one place."""
    if x[0] != y[0]:
        return False
    for i in (4, 5):
        if x[i] and y[i] and osa(x[i], y[i], 2) > 2:
            return False
    both = lambda i: bool(x[i] and y[i])
    tokens = lambda r: [r[1], r[2], r[3], *([r[4]] if both(4) else []), *([r[5]] if both(5) else [])]
    return align(tokens(x), tokens(y), "han" in (x[6], y[6])) <= ACCEPT


def _bands(number: int, street: str, town: str, seeds: np.ndarray) -> list[int]:
    s = f"^{street}$^{town}$"
    grams = {s[i : i + GRAM] for i in range(len(s) - GRAM + 1)} | {f"token {street}", f"token {town}"}
    h = np.array([hash_text(g) for g in grams], np.uint64)
    mins = ((h[None, :] ^ seeds[:, None]) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(17)).min(axis=1).reshape(BANDS, ROWS)
    return [hash_text(f"{number}|{i}|{m}") & 0x7FFFFFFFFFFFFFFF for i, m in enumerate(mins.tolist())]


def hash_text(s: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(s)


_FIELDS = ["number", "street", "way", "town", "district", "province", "script"]


def readings(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, number, street, way, town, district, province, script) of each record that can be read."""
    reader = df.sparkSession.sparkContext.broadcast(Reader(*reading_tables(df.sparkSession)))
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = reader.value
        for pdf in batches:
            rows = [(k, *x) for k, t in zip(pdf["k"].tolist(), pdf["t"].tolist()) if (x := r.read(t)) is not None]
            yield pd.DataFrame(rows, columns=["k", *_FIELDS])

    picked = df.select(df[key].alias("k"), df[text].alias("t")).filter("k is not null and t is not null")
    return picked.mapInPandas(run, f"k {kind}, number long, street string, way string, town string, district string, province string, script string").withColumnRenamed("k", key)


def _deletions(c: F.Column) -> F.Column:
    """Keys on which tokens one slip apart meet: the token and what is left of it without one letter; of long tokens, both ends, one of which
    a slip leaves whole."""
    n = F.length(c)
    less = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, n)))
    ends = F.array(F.concat(F.lit("<"), F.left(c, F.lit(19))), F.concat(F.lit(">"), F.right(c, F.lit(19))))
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.array(c), F.when(n <= LONG + 1, less).otherwise(none), F.when(n >= LONG, ends).otherwise(none)))


def respell(r: DataFrame, column: str, script: str = "latin") -> DataFrame:
    """Rare spellings of a column's tokens replaced by the most frequent one that is one slip away: a letter more, less, other or swapped.

    Tokens meet on their one-letter deletions or, where long, on their ends, so no token is compared with all others."""
    counts = r.filter(F.col("script") == script).groupBy(column).count().select(F.col(column).alias("w"), F.col("count").alias("n")).filter("length(w) >= 4")
    keys = counts.select("w", "n", F.explode(_deletions(F.col("w"))).alias("d"))
    a, b = keys.select(F.col("w").alias("bad"), F.col("n").alias("bn"), "d"), keys.select(F.col("w").alias("good"), F.col("n").alias("gn"), "d")
    near = a.join(b, "d").filter("bad <> good and gn > 2 * bn")
    lev = F.levenshtein("bad", "good")
    sorted_letters = lambda c: F.array_sort(F.split(c, ""))
    near = near.filter((lev <= 1) | ((lev == 2) & (F.length("bad") == F.length("good")) & (sorted_letters("bad") == sorted_letters("good"))))
    fix = near.groupBy("bad").agg(F.max_by("good", F.struct("gn", "good")).alias("good"))
    return r.join(fix, (F.col(column) == F.col("bad")) & (F.col("script") == script), "left").withColumn(column, F.coalesce("good", column)).drop("bad", "good")


def same_places(df: DataFrame, key: str, text: str) -> DataFrame:
    """Pairs (key_a < key_b) of records that denote one place."""
    r = cut(readings(df, key, text).distinct())
    r = cut(respell(respell(r, "street"), "town").withColumn("form", F.xxhash64(*_FIELDS)))
    forms = r.select("form", *_FIELDS).dropDuplicates(["form"])

    def band(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seeds = np.array([hash_text(f"band {i}") for i in range(BANDS * ROWS)], np.uint64)
        for pdf in batches:
            rows = [(f, b) for f, n, s, t in zip(pdf["form"], pdf["number"], pdf["street"], pdf["town"]) for b in _bands(n, s, t, seeds)]
            yield pd.DataFrame(rows, columns=["form", "band"])

    bands = forms.select("form", "number", "street", "town").mapInPandas(band, "form long, band long")
    a, b = bands.withColumnRenamed("form", "fa"), bands.withColumnRenamed("form", "fb")
    pairs = a.join(b, "band").filter("fa < fb").select("fa", "fb").distinct()
    side = lambda s: forms.select(*[F.col(c).alias(f"{s}{c}") for c in ["form", *_FIELDS]])
    pairs = pairs.join(side("x"), F.col("fa") == F.col("xform")).join(side("y"), F.col("fb") == F.col("yform")).drop("xform", "yform")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            xs = pdf[[f"x{c}" for c in _FIELDS]].itertuples(index=False, name=None)
            ys = pdf[[f"y{c}" for c in _FIELDS]].itertuples(index=False, name=None)
            keep = [same_place(x, y) for x, y in zip(xs, ys)]
            yield pdf.loc[keep, ["fa", "fb"]]

    edges = pairs.mapInPandas(verify, "fa long, fb long")
    m = r.select(F.col(key).alias("k"), "form").distinct()
    same = m.alias("a").join(m.alias("b"), "form").filter("a.k < b.k").select(F.col("a.k").alias("x"), F.col("b.k").alias("y"))
    cross = edges.join(m.select(F.col("form").alias("fa"), F.col("k").alias("x")), "fa").join(m.select(F.col("form").alias("fb"), F.col("k").alias("y")), "fb").select("x", "y")
    return same.unionByName(cross).select(F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b")).filter("key_a < key_b").distinct()
