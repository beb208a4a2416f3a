"""Repair of text from scanned pages.

Words, and short windows around characters that are easily misread, are counted over all texts. Each gets an anagram value, the sum of
the third powers of its code points; a confusion such as m for rn then is a constant difference of values, so rare words are joined
with their frequent variants on value plus difference, in SQL, and verified by the confusion itself. The most frequent variant is the
correction. Lines that are page numbers by form, and short lines that interrupt running text in several blocks or twice in one, are page
furniture. A hyphen at a line end is a cut when the joined word is attested more than the compound, or when its halves are no words.

Defined results: rows without key give none; null and empty texts have no noise and stay; mere line breaks are no noise, and repair joins them; repeated rows give one
result. Texts are treated whole; counts cover all rows. Corrections are looked up in a broadcast table while they are
fewer than ``BROADCAST_ROWS``; beyond that the same tokens are joined with them by a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.session import cut

#: True and misread characters, as recognisers confuse them (fixed values).
LATIN = [("e", "c"), ("t", "f"), ("a", "@"), ("o", "0"), ("l", "1"), ("s", "5"), ("d", "cl"), ("h", "b"), ("in", "m"), ("m", "rn"), ("i", "l"), ("w", "vv"), ("li", "h"), ("ri", "n"), ("i", "1"), ("g", "9"), ("b", "6"), ("l", "i"), ("rn", "m"), ("cl", "d")]
HAN = "的旳 成戍 件仵 为力 与写 度庋 电屯 定宁 期朝 月冃 入人 人入 模樸 项顶 线钱 采釆 已己 机杌 由甴 网冈 低抵 力刀 目曰 站姑 型垄 问间 间问 土士 天夭 未末 口囗 大太 析折 余佘 日曰 干千 千干 士土 末未 己已 太大 夭天 侯候 候侯 拔拨 拨拔 辨辩 戊戌 今令 白自 自白 甲申 申甲 厂广 木本 本木 免兔 代伐 玉王 王玉 师帅 鸟乌 乌鸟 输榆 载戴 处外 竟竞 贷货 货贷 传侍 析柝 验检 值植 组祖 科料 料科".split()
#: How much more frequent a variant must be, and how often it must occur at least.
RATIO, FREQUENT = 8, 6
#: The same for windows of two characters.
RATIO_PAIR, FREQUENT_PAIR = 25, 20
BROADCAST_ROWS = 1_000_000
#: Blocks in which a line must interrupt the text to be known as furniture.
HEADER_BLOCKS = 3

_HYPHEN = r"([A-Za-zÀ-ÿ@0-9]{1,})[-‐‑­][ \t]*\n[ \t]*([a-zà-ÿ@0-9]{1,})"
_NUM = r"[0-9OolISB]{1,4}"
PAGE_NUMBER = rf"^\s*(?:第\s*{_NUM}\s*[页貞]?\s*(?:[/,，共]?\s*共?\s*{_NUM}\s*页)?|[-—–·•~\s]*{_NUM}[-—–·•~\s]*|[-—–\s]*{_NUM}\s*/\s*{_NUM}[-—–\s]*|(?i:page|p\.?|pg\.?)\s*{_NUM}(?:\s*(?:of|0f|/)\s*{_NUM})?|[ivxlc]{{1,6}}|[IVXLC]{{1,6}})\s*$"
#: Punctuation and digits read as letters, and the reverse.
_STOPS = r"[一-鿿%％）)A-Z]o(?=\s*(?:[一-鿿\n]|$))|[一-鿿%％）)\dA-Z]'\s*[一-鿿\d]"
_DIGITS = r"(?<![A-Za-z0-9\-/.])(?:\d+[OolSBI][\dOolSBI]*|[OolSBI][OolSBI]*\d[\dOolSBI]*)(?=[一-鿿%％]|kV|\s?[a-z]{3}|\.\d|\.\n)|\d\.\n?[OolSBI](?=%|\d%)|\d\.\d?[OolSBI]%"
_END = r"[。！？；.!?;:：]\s*$"


def _value(c: Column) -> Column:
    def add(a: Column, x: Column) -> Column:
        n = F.ascii(x).cast("bigint")
        return a + n * n * n

    return F.aggregate(F.filter(F.split(c, ""), lambda x: x != ""), F.lit(0).cast("bigint"), add)


_LATIN4, _RUN = re.compile("[A-Za-z@0-9']{3}"), re.compile(r"[\w@']{4,}")
_WORD = re.compile("[A-Za-zÀ-ÿ@0-9']+")
_COMPOUND = re.compile(r"(?<![^\W\d_])[A-Za-zÀ-ÿ]{2,}-[a-zà-ÿ]{2,}(?![^\W\d_])")
_BREAK = re.compile(r"\s*\n\s*")
_BOTH = re.compile("[" + "".join(sorted({c for p in HAN for c in p})) + "]")
_BAD = re.compile("[" + "".join(sorted({p[1] for p in HAN})) + "]")


def tokens(t: str, chars: re.Pattern = _BOTH) -> list[str]:
    """Words, compounds, and windows of two and three characters around the ideographs of ``chars``, also across line breaks.

    Python's character classes are bitmaps; the same search in the JVM compares each character with every member of the class."""
    out = []
    if _LATIN4.search(t):
        out = [w.lower() for w in _RUN.findall(t) if w.isascii() or _WORD.fullmatch(w)]
        if "-" in t:
            out += [w.lower() for w in _COMPOUND.findall(t)]
    if chars.search(t):
        flat = _BREAK.sub("", t) if "\n" in t else t
        n = len(flat)
        for m in chars.finditer(flat):
            i = m.start()
            before, after = i > 0, i + 1 < n
            if before and after:
                out.append(flat[i - 1 : i + 2])
            if before and "一" <= flat[i - 1] <= "鿿":
                out.append(flat[i - 1 : i + 1])
            if after and "一" <= flat[i + 1] <= "鿿":
                out.append(flat[i : i + 2])
    return out


def vocabulary(df: DataFrame, text: str) -> DataFrame:
    """(token, n) over all rows, counted in each partition before the shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        for pdf in batches:
            for t in pdf["t"]:
                total.update(tokens(t))
            if len(total) > 1_000_000:
                yield pd.DataFrame(total.items(), columns=["token", "n"], dtype=object)
                total = Counter()
        yield pd.DataFrame(total.items(), columns=["token", "n"], dtype=object)

    t = df.filter(F.length(text) > 0).select(F.col(text).alias("t"))
    return t.mapInPandas(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))


def _differences(spark: SparkSession) -> DataFrame:
    """(difference of values, kind, a1, b1, a2, b2): the confusions of one place or, in words, of two."""
    val = lambda s: sum(ord(x) ** 3 for x in s)
    rows = [(val(b) - val(a), "word", a, b, None, None) for a, b in LATIN] + [(val(p[1]) - val(p[0]), "window", p[0], p[1], None, None) for p in dict.fromkeys(HAN)]
    rows += [(val(b) + val(d) - val(a) - val(c), "word", a, b, c, d) for i, (a, b) in enumerate(LATIN) for c, d in LATIN[i:] if (c, d) != (b, a)]
    return spark.createDataFrame(rows, "d long, kind string, a1 string, b1 string, a2 string, b2 string")


def _misreads(good: Column, bad: Column) -> Column:
    """Whether ``bad`` is ``good`` with the confusion a1 to b1, and a2 to b2 unless that is null, at some places."""

    def once(word: Column, a: Column, b: Column, then) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.length(word), F.lit(1)))
        return F.exists(at, lambda i: (F.substring(word, i, F.length(a)) == a) & then(F.concat(F.substring(word, F.lit(1), i - 1), b, F.substring(word, i + F.length(a), F.length(word)))))

    a1, b1, a2, b2 = map(F.col, ("a1", "b1", "a2", "b2"))
    return F.when(a2.isNull(), once(good, a1, b1, lambda w: w == bad)).otherwise(once(good, a1, b1, lambda w: once(w, a2, b2, lambda u: u == bad)))


def corrections(vocab: DataFrame) -> DataFrame:
    """(bad, good): rare tokens and their most frequent confusable variant."""
    spark = vocab.sparkSession
    v = vocab.filter(~F.col("token").contains("-")).select("token", "n", _value(F.col("token")).alias("v"), F.when(F.col("token").rlike(r"^[a-zà-ÿ@0-9']+$"), "word").otherwise("window").alias("kind"), F.length("token").alias("len"))
    least = F.when((F.col("kind") == "window") & (F.col("len") == 2), FREQUENT_PAIR).otherwise(FREQUENT)
    good = v.filter(F.col("n") >= least).filter("kind = 'window' or token rlike '^[a-zà-ÿ]+(n.t)?$'").select(F.col("token").alias("good"), F.col("n").alias("gn"), F.col("v").alias("gv"), "kind", F.col("len").alias("glen"))
    ratio = F.when((F.col("kind") == "window") & (F.col("len") == 2), RATIO_PAIR).otherwise(RATIO)
    rare = v.filter("kind = 'window' or (length(token) >= 4 and token rlike '[a-z]')")
    holds = F.col("token").contains(F.col("b1")) & (F.col("b2").isNull() | F.col("token").contains(F.col("b2")))
    d = F.broadcast(_differences(spark).withColumnRenamed("kind", "of"))
    j = rare.join(d, (F.col("kind") == F.col("of")) & holds).withColumn("gv", F.col("v") - F.col("d")).drop("of")
    j = j.join(good, ["kind", "gv"]).filter(F.col("gn") >= ratio * F.col("n"))
    near = (F.abs(F.col("len") - F.col("glen")) <= 2) & (F.levenshtein("token", "good") <= 6)
    fix = j.filter(near & _misreads(F.col("good"), F.col("token"))).groupBy(F.col("token").alias("bad")).agg(F.max_by("good", F.struct(F.col("gn"), F.col("good"))).alias("good"))
    return fix


def misread(df: DataFrame, key: str, text: str, vocab: DataFrame) -> DataFrame:
    """(key, bad, good): tokens of each row that are misread."""
    fix = cut(corrections(vocab))
    t = df.filter(F.length(text) > 0).select(F.col(key).alias("k"), F.col(text).alias("t"))
    kind = df.schema[key].dataType.simpleString()
    small = fix.count() <= BROADCAST_ROWS
    ship = df.sparkSession.sparkContext.broadcast({r["bad"]: r["good"] for r in fix.toLocalIterator()} if small else None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = ship.value
        for pdf in batches:
            rows = []
            for k, x in zip(pdf["k"].tolist(), pdf["t"].tolist()):
                found = set(tokens(x, _BAD))
                rows += [(k, w, known[w]) for w in found if w in known] if small else [(k, w, "") for w in found]
            yield pd.DataFrame(rows, columns=["k", "bad", "good"])

    hits = t.mapInPandas(run, f"k {kind}, bad string, good string")
    if not small:
        hits = hits.drop("good").join(fix, "bad")
    return hits.select(F.col("k").alias(key), "bad", "good")


def furniture(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, line): page numbers and running headers inside texts of three lines or more."""
    lines = F.split(F.col(text), "\n")
    multi = df.filter(F.col(text).contains("\n")).select(key, lines.alias("l")).filter(F.size("l") >= 3)
    width = F.array_max(F.transform("l", F.length))
    rows = F.transform(
        "l",
        lambda x, i: F.struct(
            x.alias("line"),
            (i + 1).alias("pos"),
            x.rlike(PAGE_NUMBER).alias("number"),
            ((i > 0) & (i < F.size("l") - 1) & (F.length(F.trim(x)) >= 2) & (F.length(x) <= F.col("w") * 0.8) & ~x.rlike(_END) & ~F.get(F.col("l"), i - 1).rlike(r"[。！？；!?;:：]\s*$")).alias("breaks"),
        ),
    )
    x = multi.withColumn("w", width).select(key, F.inline(rows))
    name = F.regexp_replace(F.trim(F.regexp_replace("line", r"\s+" + _NUM + r"\s*$", "")), r"(?<=项目|单位|人员|Project |Unit |Person )[A-Z]{1,3}", "#")
    x = cut(x.withColumn("name", name))  # lines of the few texts with several, read several times
    strict = x.filter("breaks and not number and length(name) >= 4")
    known = strict.groupBy("name").agg(F.countDistinct(key).alias("blocks")).filter(F.col("blocks") >= HEADER_BLOCKS).select("name")
    twice = strict.groupBy(key, "name").agg(F.count("*").alias("n")).filter("n >= 2").select(key, "name")
    inner = x.filter("pos > 1")
    by_name = inner.filter("not number").join(known, "name", "left_semi").select(key, "pos", "line")
    by_block = strict.join(twice, [key, "name"], "left_semi").select(key, "pos", "line")
    return x.filter("number").select(key, "pos", "line").unionByName(by_name).unionByName(by_block).distinct()


def hyphens(df: DataFrame, key: str, text: str, vocab: DataFrame) -> DataFrame:
    """(key, head, tail): words cut by a hyphen at a line end."""
    both = lambda g: F.transform(F.regexp_extract_all(F.col(text), F.lit(_HYPHEN), g), F.lower)
    x = df.filter(F.col(text).contains("\n")).filter(F.col(text).rlike(r"[A-Za-zÀ-ÿ0-9@][-‐‑­][ \t]*\n[ \t]*[a-zà-ÿ0-9@]")).select(key, F.explode(F.arrays_zip(both(1).alias("head"), both(2).alias("tail"))).alias("h")).select(key, "h.head", "h.tail").filter("head rlike '[a-zà-ÿ]' and tail rlike '[a-zà-ÿ]'")
    x = x.withColumn("joined", F.concat("head", "tail")).withColumn("compound", F.concat_ws("-", "head", "tail"))
    for c in ("joined", "compound", "head", "tail"):
        x = x.join(vocab.select(F.col("token").alias(c), F.col("n").alias(f"n_{c}")), c, "left")
    n = {c: F.coalesce(f"n_{c}", F.lit(0)) for c in ("joined", "compound", "head", "tail")}
    cut_word = (n["joined"] > n["compound"]) | ((n["compound"] == 0) & ((n["head"] < 3) | (n["tail"] < 3) | (F.length("tail") < 4)))
    return x.filter(cut_word).select(key, "head", "tail")


def find_noise(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, noise): the sorts of noise in each row, of hyphen, misread, furniture."""
    df = df.select(key, text).filter(F.col(key).isNotNull())
    vocab = cut(vocabulary(df, text))
    t = F.col(text)
    by_form = df.filter((t.rlike("o|'") & t.rlike(_STOPS)) | t.rlike(_DIGITS)).select(key, F.lit("misread").alias("noise"))
    found = by_form.unionByName(misread(df, key, text, vocab).select(key, F.lit("misread").alias("noise")))
    found = found.unionByName(furniture(df, key, text).select(key, F.lit("furniture").alias("noise")))
    found = found.unionByName(hyphens(df, key, text, vocab).select(key, F.lit("hyphen").alias("noise")))
    return found.distinct()


def repair(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, repaired): each distinct row's text without furniture, with words whole and misread tokens replaced, its lines joined."""
    base = df.select(key, text).filter(F.col(text).isNotNull() & F.col(key).isNotNull()).dropDuplicates([key])
    vocab = cut(vocabulary(base, text))
    fix = misread(base, key, text, vocab).groupBy(key).agg(F.array_sort(F.collect_set(F.struct((-F.length("bad")).alias("n"), "bad", "good"))).alias("fix"))
    drop = furniture(base, key, text).groupBy(key).agg(F.collect_set(F.col("pos")).alias("drop"))
    cuts = hyphens(base, key, text, vocab).groupBy(key).agg(F.collect_set(F.concat("head", F.lit("\n"), "tail")).alias("cuts"))
    x = base.join(fix, key, "left").join(drop, key, "left").join(cuts, key, "left")
    kept = F.filter(F.split(text, "\n"), lambda _, i: ~F.coalesce(F.array_contains("drop", i + 1), F.lit(False)))
    t = F.array_join(kept, "\n")
    t = F.aggregate(F.coalesce("cuts", F.array().cast("array<string>")), t, lambda a, c: F.regexp_replace(a, F.concat(F.lit(r"(?i)(\Q"), F.split_part(c, F.lit("\n"), F.lit(1)), F.lit(r"\E)[-‐‑­][ \t]*\n[ \t]*(\Q"), F.split_part(c, F.lit("\n"), F.lit(2)), F.lit(r"\E)")), F.lit("$1$2")))
    t = F.regexp_replace(F.regexp_replace(t, r"(?<=[一-鿿，。；：、！？（）％%\d])[ \t]*\n[ \t]*(?=[一-鿿，。；：、！？（）％%\d])", ""), r"[ \t]*\n[ \t]*", " ")
    t = F.regexp_replace(t, r"(?<=[一-鿿%％）)A-Z])o(?=\s*(?:[一-鿿]|$))", "。")
    t = F.regexp_replace(t, r"(?<=[一-鿿%％）)\dA-Z])'(?=\s*[一-鿿\d])", "，")
    same_case = lambda a, f: F.replace(F.replace(a, f["bad"], f["good"]), F.initcap(f["bad"]), F.initcap(f["good"]))
    t = F.aggregate(F.coalesce("fix", F.array().cast("array<struct<n:int,bad:string,good:string>>")), t, same_case)
    return x.select(key, t.alias("repaired"))
