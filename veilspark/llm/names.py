"""Which spellings of persons and organisations mean the same one.

Names are read into parts that do not depend on script: ideographs as syllables, titles, legal forms and branches apart. Every suffix of a
part, above a least length, is indexed; records of one scope that share a suffix are candidates. A suffix that too many records of a scope
share is not dropped but refined with the initials of the other parts. Records of one
reading are one class. Candidates are compared part by part by the ratio of their longest
common subsequence. Full names form clusters, the components of their links; a name that says less (a title, initials, a given name, an
acronym) joins a cluster only when it fits exactly one.

Defined results: names without key, null and blank ones match nothing; names that look the same are the same; branches of one organisation, and legal forms
that differ when both stand, are different; repeated rows count once. Components are found by propagating least labels in Spark, with the
lineage cut at each round; no group is gathered in one task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilspark.llm.romanise import is_han, looks, osa, reading_tables
from veilspark.session import cut

LEAST_SUFFIX, LONGEST = 2, 40
#: Records of one scope that may share a suffix before it is refined.
COMMON = 200
RATIO = 0.8

_COMPOUND = "欧阳 司马 上官 诸葛 夏侯 东方 皇甫 尉迟 公孙 慕容 长孙 宇文 司徒".split()
#: Frequent surnames (fixed values); their syllables tell a family name from a given name.
SURNAMES = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何高林罗郑梁谢宋唐许韩冯邓曹彭曾肖田董袁潘于蒋蔡余杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范金石廖贾夏韦付方白邹孟熊秦邱江尹薛闫段雷侯龙史陶黎贺顾毛郝龚邵万钱严覃武戴莫孔向汤温康施文牛樊葛邢安齐易乔伍庞颜倪庄聂章鲁岳翟殷詹申欧耿关兰焦俞左柳甘祝包宁尚符舒阮柯纪梅童凌毕单季裴霍涂成苗谷曲盛冉翁蓝路游辛靳管柴蒙鲍华喻祁蒲房滕屈饶解牟艾尤阳时穆农司卓古吉缪简车项连芦麦褚娄窦戚岑党宫费卜冷晏席卫柏卞"
#: The most frequent of them: a name of two characters that begins with another one may be a given name alone.
FIRM = set(SURNAMES[: SURNAMES.index("武") + 1]) - {"龙"}
_TITLES = "董事长 总经理 总工程师 工程师 副经理 经理 主任 老师 同志 先生 女士 教授 博士 院长 所长 处长 科长 总工 总 工".split()
_LATIN_TITLE = re.compile(r"^(?:mr/ms|mr|mrs|ms|miss|dr|prof|professor|ir|eng)\b\.?\s*", re.I)
#: Short forms of English given names (fixed values).
NICKNAMES = {
    "matt": "matthew", "bob": "robert", "rob": "robert", "bobby": "robert", "liz": "elizabeth", "beth": "elizabeth", "betty": "elizabeth", "lizzie": "elizabeth", "kate": "katherine", "kathy": "katherine", "kat": "katherine", "sam": "samuel", "ben": "benjamin", "nick": "nicholas", "chris": "christopher", "tony": "anthony", "ted": "theodore", "theo": "theodore", "fred": "frederick", "jo": "josephine", "josie": "josephine", "vicky": "victoria", "vic": "victoria", "tori": "victoria", "becky": "rebecca", "becca": "rebecca", "debbie": "deborah", "deb": "deborah", "peggy": "margaret", "maggie": "margaret", "meg": "margaret", "pat": "patricia", "patty": "patricia", "trish": "patricia", "jon": "jonathan", "alex": "alexander", "sandy": "alexander", "leo": "leonard", "len": "leonard", "lenny": "leonard", "ed": "edward", "eddie": "edward", "ned": "edward", "gabby": "gabriella", "gabi": "gabriella", "bill": "william", "will": "william", "billy": "william", "sue": "susannah", "susie": "susannah", "tom": "thomas", "jim": "james", "joe": "joseph", "mike": "michael", "dave": "david", "dan": "daniel", "jack": "john", "harry": "henry", "charlie": "charles", "dick": "richard", "rick": "richard", "andy": "andrew", "steve": "stephen", "jenny": "jennifer", "nan": "anne", "molly": "mary",
}
#: Legal and institutional forms (fixed values): spelling -> (class, form).
ZH_FORMS = {"股份有限公司": ("company", "holdings"), "有限责任公司": ("company", "llc"), "有限公司": ("company", "ltd"), "公司": ("company", ""), "设计研究院": ("institute", "design"), "设计院": ("institute", "design"), "研究院": ("institute", "research"), "研究所": ("institute", "research"), "院": ("institute", ""), "检测中心": ("centre", ""), "中心": ("centre", "")}
EN_FORMS = {"testing centre": ("centre", ""), "testing center": ("centre", ""), "centre": ("centre", ""), "design institute": ("institute", "design"), "institute": ("institute", "research"), "inst": ("institute", "research"), "co ltd": ("company", "ltd"), "company limited": ("company", "ltd"), "limited": ("company", "ltd"), "ltd": ("company", "ltd"), "llc": ("company", "llc"), "holdings": ("company", "holdings"), "corporation": ("company", "corp"), "corp": ("company", "corp"), "incorporated": ("company", "inc"), "inc": ("company", "inc"), "gmbh": ("company", "gmbh"), "company": ("company", "co"), "co": ("company", "co")}
#: Lines of business as they are translated (fixed values).
FIELDS = {"海洋工程": "marine engineering", "储能技术": "energy storage", "智能电网": "smart grid", "输变电设备": "transmission equipment", "轨道装备": "rail equipment", "新能源汽车": "electric vehicle", "生物医学工程": "biomedical engineering", "精密仪器": "precision instruments", "高分子材料": "polymer materials", "传感测控": "sensing control", "信息安全": "information security", "水务环境": "water environment"}
_NUMBER = {c: str(i) for i, c in enumerate("一二三四五六七八九", 1)}


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel: a bit of ``row`` is 0 where the length grows."""
    at: dict[str, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for y in b:
        u = row & at.get(y, 0)
        row = (row + u | row - u) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """Twice the common length over both lengths."""
    return 2 * common_length(a, b) / (len(a) + len(b)) if a and b else 0.0


class NameReader:
    """Reads names into dicts of parts."""

    def __init__(self, simple: dict[str, str], sound: dict[str, str]):
        self.simple, self.sound = simple, sound
        self.family_sounds = {sound[c] for c in SURNAMES} | {"".join(sound[x] for x in c) for c in _COMPOUND}

    def say(self, s: str) -> str:
        return "".join(self.sound.get(c, c) for c in s if is_han(c))

    def person(self, value: str) -> dict | None:
        s = looks(value)
        if not s:
            return None
        if any(map(is_han, s)):
            return self._han_person("".join(self.simple.get(c, c) for c in s if is_han(c)), s)
        return self._latin_person(s)

    def _han_person(self, s: str, shown: str) -> dict | None:
        out = {"look": s, "family": "", "given": "", "initials": "", "han": s, "other": ""}
        title = next((t for t in _TITLES if s.endswith(t) and len(s) > len(t)), "")
        core = s[: len(s) - len(title)] if title else s
        if title in ("总", "工") and len(core) > 2:
            title, core = "", s
        if s[0] in "老小" and len(s) in (2, 3) and not title:
            core, title = s[1:], s[0]
        out["han"] = core
        compound = next((c for c in _COMPOUND if core.startswith(c)), None) or (core[:2] if len(core) >= 3 and self.say(core[:2]) in ("ouyang", "sima") else None)
        if title == "同志" and len(core) == 2 and not compound:
            out["given"] = self.say(core)  # how colleagues are called; a full name of two characters is the other reading
            if core[0] in SURNAMES:
                out["other"] = f"{self.say(core[0])} {self.say(core[1])}"
        elif title and title != "同志" and (len(core) == 1 or core == compound):
            out["family"] = self.say(core)
        elif compound and core == compound:
            out["family"] = self.say(core)
        elif compound:
            out["family"], out["given"] = self.say(compound), self.say(core[len(compound) :])
        elif len(core) == 1:
            out["family"] = self.say(core)
        elif len(core) == 2 and core[0] not in SURNAMES:
            # A given name, or a full name whose family name is misspelt by another character of its sound.
            out["given"] = self.say(core)
            if self.sound.get(core[0]) in self.family_sounds:
                out["other"] = f"{self.say(core[0])} {self.say(core[1])}"
        else:
            out["family"], out["given"] = self.say(core[0]), self.say(core[1:])
            if len(core) == 2:
                out["other"] = f" {self.say(core)}"
        out["letters"] = "".join(self.sound.get(c, "")[:1] for c in core[len(compound) if compound else 1 :])
        return out

    def _latin_person(self, s: str) -> dict | None:
        out = {"look": re.sub("[^a-z]", "", s.lower()), "family": "", "given": "", "initials": "", "han": "", "other": "", "letters": ""}
        t, n = _LATIN_TITLE.subn("", s)
        comma = "," in t
        words = [w for w in re.split(r"[\s,]+", t.strip()) if w]
        if not words:
            return None
        short = [w for w in words if re.fullmatch(r"(?:[A-Za-z]\.)+[A-Za-z]?\.?|[A-Z]", w)]
        full = [w for w in words if w not in short]
        low = [re.sub("[^a-z]", "", w.lower()) for w in full]
        low = [w for w in low if w]
        if len(low) >= 2:
            if comma or len(low) == 2 and full[0].isupper() and not full[1].isupper():
                out["family"], out["given"] = low[0], "".join(low[1:])
            elif full[-1].isupper() and not full[0].isupper():
                out["family"], out["given"] = low[-1], "".join(low[:-1])
            elif low[0] in self.family_sounds and low[-1] not in self.family_sounds:
                out["family"], out["given"] = low[0], "".join(low[1:])
            elif low[-1] in self.family_sounds and low[0] not in self.family_sounds:
                out["family"], out["given"] = low[-1], "".join(low[:-1])
            else:
                out["family"], out["given"] = low[-1], "".join(low[:-1])
                out["other"] = f"{low[0]} {''.join(low[1:])}"
            out["given"] = NICKNAMES.get(out["given"], out["given"])
        elif len(low) == 1:
            if short:
                out["family"], out["initials"] = low[0], re.sub("[^a-z]", "", "".join(short).lower())
            elif n:
                out["family"] = low[0]
            else:
                out["given"], out["other"] = NICKNAMES.get(low[0], low[0]), f"{low[0]} "
        else:
            return None
        return out

    def organisation(self, value: str) -> dict | None:
        s = looks(value)
        if not s:
            return None
        if any(map(is_han, s)):
            return self._han_organisation("".join(self.simple.get(c, c) for c in s))
        return self._latin_organisation(s)

    def _field(self, s: str) -> tuple[float, str]:
        """(fit, known line of business) of an abbreviation or misspelling in ideographs."""
        best = (0.0, "")
        for f in FIELDS:
            c = common_length(s, f)
            fit = (1.0 if s == f else 0.97 if c == len(s) >= 2 else 2 * c / (len(s) + len(f))) if s else 0.0
            best = max(best, (fit, f))
        return best

    def _han_organisation(self, s: str) -> dict | None:
        s = s.replace("硏", "研")
        branch = ""
        if m := re.search(r"第?([一二三四五六七八九\d])分公[司事]$", s.strip()):
            branch, s = _NUMBER.get(m[1], m[1]), s.strip()[: m.start()]
        aside = re.search(r"[（(]([^（）()]*)[)）]", s)
        inner = re.sub(r"[^一-鿿]", "", aside[1]) if aside else ""
        spaced = [re.sub("[^一-鿿]", "", x) for x in re.sub(r"[（(][^（）()]*[)）]", " ", s).split()] if not aside else []
        body = re.sub(r"[^一-鿿]", "", re.sub(r"[（(][^（）()]*[)）]", "", s))
        body = re.sub("公[事]$", "公司", body)
        form = next((f for f in ZH_FORMS if body.endswith(f)), "")
        rest = body[: len(body) - len(form)] if form else body
        city = brand = ""
        if m := re.match(r"(..)市(.+)$", rest):
            city, rest = m[1], m[2]
        if len(spaced) >= 3 and len(spaced[0]) == 2 and len(spaced[1]) == 2 and not city:
            city, brand, rest = spaced[0], spaced[1], rest[4:]
        elif inner and len(inner) == 4:
            city, brand = inner[:2], inner[2:]
        elif inner and len(inner) == 2:
            city, brand, rest = inner, rest[:2], rest[2:]
        elif city:
            brand, rest = rest[:2], rest[2:]
        else:
            one, two = self._field(rest[2:]), self._field(rest[4:]) if len(rest) >= 6 else (0.0, "")
            if two[0] > one[0]:
                city, brand, rest = rest[:2], rest[2:4], rest[4:]
            else:
                brand, rest = rest[:2], rest[2:]
        fit, field = self._field(rest)
        field = FIELDS[field] if fit >= 0.6 else self.say(rest)
        kind, detail = ZH_FORMS.get(form, ("", ""))
        return {"look": body + branch, "brand": self.say(brand), "city": self.say(city), "field": field, "class": kind, "form": detail, "branch": branch, "acronym": "", "han": brand, "letters": ""}

    def _latin_organisation(self, s: str) -> dict | None:
        low = re.sub(r"\bg\s*m\s*b\s*h\b", "gmbh", re.sub(r"[.]", " ", s.lower()).replace("&", " ")) if re.search(r"g\.\s?m", s.lower()) else s.lower().replace(".", " ").replace("&", " ")
        low = re.sub(r"\s+", " ", low).strip()
        branch = ""
        if m := re.search(r"\b(?:(north|south|east|west|central) branch|branch (?:no )?(\d))$", low):
            branch, low = m[1] or m[2], low[: m.start()].strip()
        low = re.sub(r"^the ", "", low)
        swap = re.fullmatch(r"([^,]+), ([^,\s]+)", low)
        if swap and swap[2] not in ("ltd", "inc", "llc"):
            low = f"{swap[2]} {swap[1]}"
        low = re.sub(r"[^a-z ]", " ", low)
        low = re.sub(r"\s+", " ", low).strip()
        form = next((f for f in EN_FORMS if low.endswith(" " + f)), "")
        rest = low[: len(low) - len(form)].strip() if form else low
        words = rest.split()
        if not words:
            return None
        kind, detail = EN_FORMS.get(form, ("", ""))
        one = {"look": low.replace(" ", "") + branch, "city": "", "class": kind, "form": detail, "branch": branch, "han": ""}
        if len(words) == 1 and 2 <= len(words[0]) <= 5 and (form or branch):
            return one | {"brand": "", "field": "", "acronym": words[0], "letters": words[0]}
        return one | {"brand": words[0], "field": " ".join(words[1:]), "acronym": "", "letters": "".join(w[0] for w in words)}


def _word_fits(a: str, b: str) -> bool:
    """Whether one word is a misspelling or an abbreviation of the other."""
    if a == b:
        return True
    short, long = sorted((a, b), key=len)
    if short and short[0] == long[0] and common_length(short, long) == len(short) and len(short) >= 2 and len(long) - len(short) >= 2:
        return True
    return ratio(a, b) >= RATIO and osa(a, b, 2) <= (2 if min(len(a), len(b)) >= 8 else 1)


def _field_fits(a: str, b: str) -> bool:
    if not a or not b or a == b:
        return True
    x, y = a.split(), b.split()
    if len(x) != len(y):
        return ratio(a, b) >= RATIO
    return all(map(_word_fits, x, y))


def _slip(a: str, b: str, seen: dict[str, int]) -> bool:
    """Whether one character of two is a rare one where the other has a frequent one."""
    d = [(x, y) for x, y in zip(a, b) if x != y]
    if len(a) != len(b) or len(a) < 2 or len(d) != 1:
        return False
    few, many = sorted((seen.get(d[0][0], 0), seen.get(d[0][1], 0)))
    return many >= 20 and few * 20 <= many


def same_organisation(a: dict, b: dict, seen: dict[str, int] | None = None) -> str:
    """'' , 'weak' or 'strong'; ``seen`` counts the characters of all names, which tells slips from other names."""
    if a["branch"] != b["branch"]:
        return ""
    if a["class"] and b["class"] and a["class"] != b["class"]:
        return ""
    latin = not a["han"] and not b["han"]
    if a["form"] and b["form"] and a["form"] != b["form"] and not (a["class"] == "company" and not latin):
        return ""
    if a["form"] and b["form"] and a["form"] != b["form"] and a["han"] and b["han"]:
        return ""
    if a["acronym"] or b["acronym"]:
        return "weak" if (a["acronym"] or a["letters"]) == (b["acronym"] or b["letters"]) else ""
    if a["city"] and b["city"] and a["city"] != b["city"]:
        return ""
    if a["brand"] == b["brand"]:
        fits = True
    elif a["han"] and b["han"]:
        near = len(a["han"]) == len(b["han"]) and any(x == y for x, y in zip(a["han"], b["han"])) and osa(a["brand"], b["brand"], 2) <= 2
        fits = bool(a["city"] and b["city"]) and (near or _slip(a["han"], b["han"], seen or {}))
    else:
        fits = _word_fits(a["brand"], b["brand"]) and min(len(a["brand"]), len(b["brand"])) >= 5 and not (a["han"] or b["han"])
    return "strong" if fits and _field_fits(a["field"], b["field"]) else ""


def _parts_fit(x: tuple[str, str], y: tuple[str, str], han: bool) -> bool:
    if han:
        return x == y
    one, two = ratio(x[0], y[0]), ratio(x[1], y[1])
    edits = lambda p, q: osa(p, q, 2) <= (2 if min(len(p), len(q)) >= 7 else 1)
    return one >= RATIO and two >= RATIO and edits(x[0], y[0]) and edits(x[1], y[1])


def _readings(r: dict) -> list[tuple[str, str]]:
    out = [(r["family"], r["given"])]
    if r["other"]:
        f, g = r["other"].split(" ", 1)
        out.append((f, NICKNAMES.get(g, g)))
    return out


def same_person(a: dict, b: dict) -> str:
    """'' , 'weak' or 'strong'."""
    syllables = bool(a["han"] or b["han"])
    best = ""
    for x in _readings(a):
        for y in _readings(b):
            if x[0] and x[1] and y[0] and y[1]:
                if _parts_fit(x, y, syllables):
                    if a["han"] and b["han"] and not set(a["han"]) & set(b["han"]):
                        continue
                    return "strong"
            elif not (x[0] and x[1]) and not (y[0] and y[1]):
                continue
            else:
                full, less, who, lesser = (x, y, a, b) if x[0] and x[1] else (y, x, b, a)
                if less[0] and lesser["initials"]:
                    letters = who["letters"] or full[1][:1]
                    fits = less[0] == full[0] or not syllables and _word_fits(less[0], full[0]) and len(full[0]) >= 5
                    if fits and (letters == lesser["initials"] or not who["han"] and lesser["initials"].startswith(full[1][:1]) and (len(lesser["initials"]) == 1 or not who["letters"])):
                        best = "weak"
                elif less[0] and not less[1]:
                    if less[0] == full[0] or not syllables and _word_fits(less[0], full[0]) and len(full[0]) >= 5:
                        best = "weak"
                elif less[1] and less[1] == full[1] and len(less[1]) >= 4:
                    best = "weak"
    return best


def is_full(r: dict) -> bool:
    """Whether a name says enough to found a cluster."""
    if "brand" in r:
        return bool(r["brand"]) and not r["acronym"]
    if len(r["han"]) == 2 and r["han"][0] not in FIRM and r["other"]:
        return False
    if r["family"] and r["given"]:
        return True
    return bool(r["other"]) and all(r["other"].split(" ", 1)) and not r["given"]


def _tokens(r: dict) -> list[str]:
    if "brand" in r:
        whole = ["=" + (r["acronym"] or (r["letters"] if not r["han"] else "")), "=" + r["city"]]  # compared whole
        return [x for x in (r["brand"], *whole) if len(x) > 1]
    out = {r["family"], r["given"]}
    if r["other"]:
        out |= set(r["other"].split(" ", 1))
    return [x for x in out if len(x) >= LEAST_SUFFIX]


def suffixes(token: str) -> list[str]:
    """The suffixes of a token that are long enough to tell something, whole token included."""
    if token[0] == "=":
        return [token]
    # Tokens that share a longer suffix share its last ``LONGEST`` letters.
    least, longest = max(LEAST_SUFFIX, min(len(token), 4)), min(len(token), LONGEST)
    out = [token[len(token) - n :] for n in range(least, longest + 1)]
    # A slip in the last letters leaves no suffix; the beginning stands in, as a suffix of the token read backwards.
    return out + ["<" + token[:n] for n in range(5, longest + 1)]


_PERSON = ["look", "family", "given", "initials", "han", "other", "letters"]
_ORGANISATION = ["look", "brand", "city", "field", "class", "form", "branch", "acronym", "han", "letters"]


def _cluster(full: DataFrame, links: DataFrame) -> DataFrame:
    """(k, c): least key of the component of each full name."""
    both = cut(links.select("x", "y").union(links.select(F.col("y"), F.col("x"))).distinct())
    label = cut(full.select("k", F.col("k").alias("c")))
    while True:
        near = both.join(label, both["y"] == label["k"]).groupBy("x").agg(F.min("c").alias("m"))
        new = cut(label.join(near, label["k"] == near["x"], "left").select("k", F.least("c", F.coalesce("m", "c")).alias("c")))
        # Labels of labels: a chain halves at each round.
        root = new.select(F.col("k").alias("c"), F.col("c").alias("r"))
        new = cut(new.join(root, "c", "left").select("k", F.least("c", F.coalesce("r", "c")).alias("c")))
        moved = new.join(label.withColumnRenamed("c", "before"), "k").filter("c <> before").limit(1).count()
        label = new
        if not moved:
            return label


def same_names(df: DataFrame, key: str, scope: list[str], text: str, kind: str) -> DataFrame:
    """Pairs (key_a < key_b) within ``scope`` that mean the same one; ``kind`` is person or organization."""
    spark = df.sparkSession
    reader = spark.sparkContext.broadcast(NameReader(*reading_tables(spark)))
    fields = _PERSON if kind == "person" else _ORGANISATION
    kt = df.schema[key].dataType.simpleString()
    scoped = df.select(F.col(key).alias("k"), F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in scope]).alias("s"), F.col(text).alias("t")).filter("k is not null and t is not null").distinct()

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = reader.value
        for pdf in batches:
            rows = []
            for k, s, t in zip(pdf["k"].tolist(), pdf["s"].tolist(), pdf["t"].tolist()):
                x = r.person(t) if kind == "person" else r.organisation(t)
                if x:
                    rows.append((k, s, is_full(x), *[x[f] for f in fields]))
            yield pd.DataFrame(rows, columns=["k", "s", "full", *fields])

    every = cut(scoped.mapInPandas(read, f"k {kt}, s string, full boolean, " + ", ".join(f"`{f}` string" for f in fields)))
    # Records of one reading are one class, compared once through its least key.
    reading = ["s", *[f"`{f}`" for f in fields]]
    r = cut(every.groupBy(*reading).agg(F.min("k").alias("k"), F.first("full").alias("full"), F.count("*").alias("times")))

    # How often each ideograph stands in brands: one entry for each character of the script at most.
    counted = every.filter("han <> ''").select(F.explode(F.split("han", "")).alias("c")).filter("c <> ''").groupBy("c").count()
    letters = spark.sparkContext.broadcast({x["c"]: x["count"] for x in counted.collect()} if kind != "person" else {})

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = set()
            for x in pdf.to_dict("records"):
                parts = _tokens(x)
                for p in parts:
                    rest = sorted({q.strip("=")[:1] for q in parts if q != p} | set(x["initials"] if kind == "person" else x["field"][:1])) or [""]
                    rows |= {(x["k"], x["s"], z, tuple(rest)) for z in suffixes(p)}
            yield pd.DataFrame([(k, s, z, list(i)) for k, s, z, i in rows], columns=["k", "s", "z", "i"])

    idx = r.mapInPandas(index, f"k {kt}, s string, z string, i array<string>")
    idx = idx.withColumn("n", F.count("*").over(Window.partitionBy("s", "z")))
    # A common suffix is refined with the initial of another part, or with none where a record has no other part: a name of one part that
    # many records share fits several of them, and so would join none.
    fine = F.when(F.col("n") > COMMON, F.array_union("i", F.array(F.lit("")))).otherwise(F.array(F.lit("*")))
    idx = idx.select("k", "s", "z", F.explode(fine).alias("f"), (F.size("i") == 1) & (F.col("i")[0] == ""))
    idx = idx.toDF("k", "s", "z", "f", "bare").filter("f <> '' or bare or f = '*'").select("k", "s", "z", "f").distinct()
    a, b = idx.withColumnRenamed("k", "x"), idx.withColumnRenamed("k", "y")
    pairs = a.join(b, ["s", "z", "f"]).filter("x < y").select("x", "y").distinct()
    side = lambda p: r.select(F.col("k").alias(f"{p}k"), F.col("full").alias(f"{p}full"), *[F.col(f"`{f}`").alias(f"{p}_{f}") for f in fields])
    pairs = pairs.join(side("a"), F.col("x") == F.col("ak")).join(side("b"), F.col("y") == F.col("bk"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        test = same_person if kind == "person" else lambda p, q: same_organisation(p, q, letters.value)
        for pdf in batches:
            left = pdf[[f"a_{f}" for f in fields]].set_axis(fields, axis=1).to_dict("records")
            right = pdf[[f"b_{f}" for f in fields]].set_axis(fields, axis=1).to_dict("records")
            how = [test(p, q) for p, q in zip(left, right)]
            out = pdf[["x", "y", "afull", "bfull"]].assign(how=how)
            yield out[out["how"] != ""]

    links = pairs.mapInPandas(compare, f"x {kt}, y {kt}, afull boolean, bfull boolean, how string")
    # Names that look the same are one, whatever they say.
    look = r.filter("look <> ''").select("k", "s", "look", "full")
    first = look.groupBy("s", "look").agg(F.min("k").alias("x"), F.count("*").alias("n")).filter("n > 1")
    alike = look.join(first, ["s", "look"]).filter("k <> x").select("x", F.col("k").alias("y"), F.col("full").alias("afull"), F.col("full").alias("bfull"), F.lit("alike").alias("how"))
    links = cut(links.unionByName(alike))
    strong = links.filter("how = 'strong' or how = 'alike'")
    label = _cluster(r, strong)
    founded = label.join(r.filter("full").select("k"), "k").select("c").distinct()
    weak = links.filter("how = 'weak'").select("x", "y").union(links.filter("how = 'weak'").select(F.col("y"), F.col("x"))).toDF("w", "o")
    named = weak.join(label.select(F.col("k").alias("w"), F.col("c").alias("wc")), "w").join(label.select(F.col("k").alias("o"), F.col("c").alias("oc")), "o")
    named = named.join(founded.select(F.col("c").alias("oc")), "oc").join(founded.select(F.col("c").alias("wc")), "wc", "left_anti")
    one = named.groupBy("wc").agg(F.min("oc").alias("to"), F.max("oc").alias("last")).filter("to = last").select(F.col("wc").alias("c"), "to")
    final = label.join(one, "c", "left").select("k", F.coalesce("to", "c").alias("c"))
    same = [F.col(f"e.{c}") == F.col(f"r.{c}") for c in reading]
    m = cut(every.alias("e").join(r.alias("r"), same).select(F.col("e.k").alias("k"), F.col("r.k").alias("rep")).join(final.select(F.col("k").alias("rep"), "c"), "rep").select("k", "c"))
    return m.alias("a").join(m.alias("b"), "c").filter("a.k < b.k").select(F.col("a.k").alias("key_a"), F.col("b.k").alias("key_b")).distinct()
