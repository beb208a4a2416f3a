"""Personal data in free text, found by bootstrapped contextual extraction, and redacted.

Entities of the table seed the search. What may be personal data is a candidate: runs of digits, things with an at sign or its spellings,
numbers beside a way, and names built of the letters and words of known persons. A candidate has patterns: its signature (how it is
written, from separators and lengths) and its contexts of several lengths (before, after, both, the label of its table row). Spark scores
the graph of patterns and instances: a pattern is as good as the share of known among its distinct instances, smoothed by one unknown
instance; instances of good patterns become known, and again, until the good patterns stay. So contexts of seeds discover other
notations, and their signatures discover the same notation elsewhere. For names a second pass collects everything that stands in a
promising context, names or not, so that contexts of other words fall; the contexts that stand discover names of any letters.
Numbers, addresses and mails of a good pattern are checked exactly at the end.

Defined results: rows without key give none; null and empty texts hold nothing; placeholders such as 人员A are not personal data; place names without a street number
are no address; repeated rows give one result. Texts are treated whole. Without seeds of a kind nothing of that kind is found.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.functions.chars import INVISIBLE_CLASS, LOOKALIKES, fold_width
from veilspark.operators.rules import RULES
from veilspark.session import cut

_TOKEN = r"[a-z0-9](?:[a-z0-9._%+-]*[a-z0-9_])?"
_DOT = r"(?:\.|\s?\[dot\]\s?|\s?\(dot\)\s?|\sdot\s)"
_WORD_DOT = r"(?:\.|\s?\[dot\]\s?|\s?\(dot\)\s?|\sdot\s)"
EMAIL = rf"(?i)(?<![a-z0-9._%+-]){_TOKEN}(?:\s?@\s?|\s?\[at\]\s?|\s?\(at\)\s?|\sat\s(?=[a-z0-9-]+(?:{_WORD_DOT}[a-z0-9-]+)*(?:\s?[\[(]dot[\])]|\sdot\s|\.(?:com|org|net|cn|edu|gov|example|test|invalid)\b)))[a-z0-9-]+(?:{_DOT}[a-z0-9-]+)*{_DOT}[a-z]{{2,}}"
_DATE = r"(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])"
ID_CARD = rf"(?<![0-9A-Za-z])[1-9]\d{{5}}[ -]?(?:(?:18|19|20)\d{{2}}{_DATE}[ -]?\d{{3}}[\dXx]|\d{{2}}{_DATE}[ -]?\d{{3}})(?![0-9A-Za-z])"
_HAN_DIGIT = "〇零幺一二三四五六七八九"
PHONE = rf"(?<![0-9A-Za-z.])(?:\(?(?:\+|00)86\)?[ -]?)?1[3-9]\d(?:[ .-]?\d{{4}}){{2}}(?![0-9A-Za-z])|(?<![0-9A-Za-z])(?:\(0\d{{2,3}}\)[ -]?|0\d{{2,3}}[ -])\d{{7,8}}(?![0-9A-Za-z])|(?<![{_HAN_DIGIT}])[幺一][三四五六七八九][{_HAN_DIGIT}]{{9}}(?![{_HAN_DIGIT}])"
_WAY = r"(?:street|str|st|road|rd|avenue|ave|av|lane|ln|la|drive|drv|dr|court|crt|ct|terrace|ter|square|sq|boulevard|blvd|close|crescent|way)"
HAN_ADDRESS = r"[一-鿿]{1,4}(?:大道|路|街|巷|弄|胡同)\s?(?:门牌\s?\d{1,5}|(?:\d{1,5}|[一二三四五六七八九十百千零〇]{1,8})\s?[号號#])"
LATIN_ADDRESS = rf"(?i:(?:\bno\. ?|#)?\b\d{{1,5}},? (?:[a-z]+ ){{1,3}}{_WAY}\b|(?<![a-z])(?:[a-z]+ ){{1,3}}{_WAY}\.?,? (?:no\. ?|#)?\d{{1,5}}\b(?! ?[%-]))"
ADDRESS = f"{HAN_ADDRESS}|{LATIN_ADDRESS}"
_PROVINCE = "北京|天津|上海|重庆|河北|山西|辽宁|吉林|黑龙江|江苏|浙江|安徽|福建|江西|山东|河南|湖北|湖南|广东|海南|四川|贵州|云南|陕西|甘肃|青海|台湾|内蒙古|广西|西藏|宁夏|新疆"
#: What may stand before a street, and is replaced with it.
ADDRESS_HEAD = rf"(?:(?:{_PROVINCE})(?:省|市|自治区)?[\s，,-]{{0,2}})?(?:[一-鿿]{{2,3}}?市[\s，,-]{{0,2}})?(?:[一-鿿]{{2,3}}?[区县][\s，,-]{{0,2}})?"
SHAPES = {"email": EMAIL, "phone": PHONE, "id_card": ID_CARD, "address": ADDRESS}

CHECK = {k: re.compile(p) for k, p in SHAPES.items()}
WHOLE_ADDRESS = re.compile(f"{ADDRESS_HEAD}{HAN_ADDRESS}|{LATIN_ADDRESS}")
#: Runs of digits that may be a number of a person, or any other number.
_NET = re.compile(rf"(?<![0-9A-Za-z.])[+(]{{0,2}}\d(?:[ .()-]{{0,2}}\d){{8,23}}[Xx]?(?![0-9A-Za-z])|[{_HAN_DIGIT}]{{9,}}")
#: What a text must hold to have any of them; most texts do not.
_MAIL_SIGN = re.compile(r"(?i)@|\(at\)|\[at\]|\sat [a-z0-9-]+\s?(?:\.|[\[(]?dot)")
_PLACE_SIGN, _WAY_SIGN, _WORDS = re.compile(r"[路街巷弄道同]\s?[门\d一二三四五六七八九十百千零〇]"), re.compile(rf"(?i)\b{_WAY}\b"), re.compile("[A-Za-z] [A-Za-z]")

#: A name in Latin letters; a name in ideographs, whose letters may stand apart.
LATIN_NAME = r"(?:[A-Z][a-z]+|[A-Z]{3,}|[A-Z]{2,}(?=,)|[A-Z]\.(?:[A-Z]\.)?),? (?:[A-Z]\. )?(?:[A-Z][a-z]+|[A-Z]{2,}|[A-Z]\.(?:[A-Z]\.)?)"
HAN_NAME = "[一-鿿](?: ?[一-鿿]){1,3}"
#: Share of known instances from which a pattern stands; what is added against it, so that one instance of a name is not enough; and what an
#: instance with a fitting shape that is not known yet counts against a context; nothing against a signature, which is the shape.
STANDS, DOUBT, UNKNOWN = 0.6, 0.5, 0.2

#: Full-width punctuation that the patterns know as it is; everything else wide is folded.
_KEEP = "，；：！？"
_INVISIBLE = re.compile(INVISIBLE_CLASS)
_FOLD = {n: n - 0xFEE0 for n in range(0xFF01, 0xFF5F) if chr(n) not in _KEEP} | dict.fromkeys([0x3000, 0xA0, 0x202F, *range(0x2000, 0x200B)], 0x20) | {ord(a): b for a, b in LOOKALIKES.items()}
_PLAIN = re.compile(r"[ -~一-鿿、。，；：！？“”]*")


_PLAIN_LINES = re.compile(r"[ -~一-鿿、。，；：！？“”\n]*")
_STUCK, _BREAK = re.compile(r"(?<=[0-9一-鿿@._-])\n(?=[0-9一-鿿@._-])"), re.compile(r" ?\n[ \n]*")


def _sticks(c: str) -> bool:
    return c in "0123456789@._-" or "一" <= c <= "鿿"


def fold(t: str) -> str:
    """The text as the patterns see it: width and look-alikes folded, nothing invisible, what a line break parts joined, other breaks as spaces."""
    if _PLAIN.fullmatch(t):
        return t
    if _INVISIBLE.search(t):
        t = _INVISIBLE.sub("", t)
    if not _PLAIN_LINES.fullmatch(t):
        t = t.translate(_FOLD)
    return _BREAK.sub(" ", _STUCK.sub("", t)) if "\n" in t else t


def fold_with_positions(t: str) -> tuple[str, list[int]]:
    """``fold`` and the place in ``t`` of each of its characters."""
    seen = [(i, c) for i, c in enumerate(t) if not _INVISIBLE.match(c)]
    seen = [(i, x) for i, c in seen for x in c.translate(_FOLD)]
    out, at, n = [], [], len(seen)
    for j, (i, c) in enumerate(seen):
        if c == "\n" and out and j + 1 < n and _sticks(out[-1]) and _sticks(seen[j + 1][1]):
            continue
        c = " " if c == "\n" else c
        if c == " " and out and out[-1] == " " and "\n" in t[at[-1] : i + 1]:
            continue
        out.append(c)
        at.append(i)
    return "".join(out), at


class Found(NamedTuple):
    """A candidate of a text: kind '' where no check of a kind agrees."""

    slot: str
    kind: str
    start: int
    end: int


def found_shapes(t: str) -> list[Found]:
    """Candidates that have a shape: what the checks of the kinds accept, and other long numbers."""
    out = []
    numbers = [m.span() for m in _NET.finditer(t)]
    if numbers:
        taken: list[tuple[int, int]] = []
        for kind in ("id_card", "phone"):
            for m in CHECK[kind].finditer(t):
                if all(m.end() <= a or m.start() >= b for a, b in taken):
                    taken.append(m.span())
                    out.append(Found("number", kind, *m.span()))
        out += [Found("number", "", a, b) for a, b in numbers if all(b <= x or a >= y for x, y in taken)]
    if _MAIL_SIGN.search(t):
        out += [Found("mail", "email", *m.span()) for m in CHECK["email"].finditer(t)]
    if _PLACE_SIGN.search(t) or _WORDS.search(t) and _WAY_SIGN.search(t):
        out += [Found("place", "address", *m.span()) for m in CHECK["address"].finditer(t)]
    return out


_AT = re.compile(r"(?i)\s?@\s?|\s?\[at\]\s?|\s?\(at\)\s?|\sat\s")
_RUN = re.compile(r"\d+")
_COUNTRY = re.compile(r"^\(?(?:\+|00)86\)?[ -]?")
_HAN_RUN = re.compile(f"[{_HAN_DIGIT}]+")
_DOTS = re.compile(r"(?i)\s?\[dot\]\s?|\s?\(dot\)\s?|\sdot\s|\.")
_WAY_OF = re.compile(rf"(?i:\b{_WAY}\b)|大道|路|街|巷|弄|胡同")


def signatures(slot: str, s: str) -> list[str]:
    """How a candidate is written, an address also without its sort of way."""
    if slot == "number":
        s = _COUNTRY.sub("", s)
        digits = re.sub(r"\D", "", s)
        first = digits[:1] if len(digits) < 15 else ""
        if not digits:
            return [f"han {len(s)} {'1' if s[0] in '幺一' else ''}"]
        return [f"{first} " + _RUN.sub(lambda m: str(len(m[0])), re.sub("[Xx]$", "0", s))]
    if slot == "mail":
        m = _AT.search(s)
        return [m[0].lower() + (_DOTS.search(s, m.end()) or [""])[0].lower()]
    m = None
    for m in _WAY_OF.finditer(s):
        pass
    way, tail = m[0].lower(), s[m.end() :]
    if "一" <= way[0] <= "鿿":
        style = " " + re.sub("[一二三四五六七八九十百千零〇]+", "N", _RUN.sub("0", tail))
    else:
        style = (" after" if _RUN.search(tail) else " before") + (" #" if "#" in s else " no" if re.match("(?i)no", s) else "")
    return [way + style, style]


#: Two words of a name in a row; cheaper than the whole pattern, which most texts cannot match.
_CAPITALS = re.compile(r"[A-Z][A-Za-z.]*,? [A-Z]")
_LATIN = re.compile(LATIN_NAME)
_LATIN_END = re.compile(f"(?<![A-Za-z])(?:{LATIN_NAME})$")
_LEFT_WORDS = re.compile(r"(?:[A-Za-z.]+ [a-z]+ |[A-Z][a-z]+: )$")
_RIGHT_WORDS = re.compile(r" [a-z]+ [a-z]+")
_LABEL_CELLS = " | "
#: Ideographs and their punctuation; letters of other scripts are too few to make a context without words.
_WIDE = re.compile("[\u2e80-\uffff]")
_HAN_CELL, _LATIN_CELL = re.compile(HAN_NAME), re.compile(LATIN_NAME)


def _label(cell: str) -> str:
    return re.sub(r"\d+", "#", cell)


def contexts(t: str, a: int, b: int) -> list[str]:
    """The context patterns of a stretch: before (L, l), after (R, r) and both (P), by letters or, beside Latin words, by words."""
    out = []
    left, right = t[max(0, a - 3) : a], t[b : b + 3]
    if m := _LEFT_WORDS.search(t, max(0, a - 48), a):
        out.append(f"l\t{m[0]}")
    elif len(left) == 3 and _WIDE.search(left):
        out.append(f"L\t{left}")
    if m := _RIGHT_WORDS.match(t, b):
        out.append(f"r\t{m[0]}")
    elif len(right) == 3 and _WIDE.search(right):
        out.append(f"R\t{right}")
    if left and len(right) > 1 and left[-1] > "\u2e7f" and _WIDE.search(right[:2]):
        out.append(f"P\t{left[-1]}\t{right[:2]}")
    if len(left) > 1 and right and right[0] > "\u2e7f" and _WIDE.search(left[-2:]):
        out.append(f"P\t{left[-2:]}\t{right[0]}")
    return out


class NameLetters:
    """What names of known persons are made of: first and later ideographs, and Latin words, each of two persons or more."""

    def __init__(self, first: str, later: str, words: set[str]):
        self.first, self.later, self.words = set(first), set(later), words
        self.core = re.compile(f"(?:[{first}](?: ?[{later}]){{1,3}})") if first and later else None

    def shaped(self, name: str) -> bool:
        if "一" <= name[0] <= "鿿":
            n = name.replace(" ", "")
            return n[0] in self.first and set(n[1:]) <= self.later
        return any(w.lower() in self.words for w in re.findall("[A-Za-z]{2,}", name))

    def candidates(self, t: str) -> Iterator[tuple[int, int]]:
        if self.core is not None:
            for m in self.core.finditer(t):
                yield m.span()
        if _CAPITALS.search(t):
            for m in _LATIN.finditer(t):
                if self.shaped(m[0]):
                    yield m.span()


def _cells(t: str) -> Iterator[tuple[str, int, int]]:
    """(label, start, end) of the cells of a table row behind its first."""
    if _LABEL_CELLS in t:
        first, *cells = t.split(_LABEL_CELLS)
        at = len(first) + 3
        for c in cells:
            a = at + len(c) - len(c.lstrip())
            yield _label(first), a, a + len(c.strip())
            at += len(c) + 3


def _names(entities: DataFrame) -> DataFrame:
    e = entities.filter("kind = 'person' and original is not null")
    return e.select(F.trim(F.regexp_replace(fold_width(F.col("original")), r"\s+", " ")).alias("name")).distinct()


def name_letters(entities: DataFrame) -> NameLetters:
    """Bounded by the script and by the words that two known names share."""
    names = _names(entities)
    han = names.filter(F.col("name").rlike(r"^\p{IsHan}(?: ?\p{IsHan}){1,3}$")).select(F.regexp_replace("name", " ", "").alias("n"))
    latin = names.filter(F.col("name").rlike("[A-Za-z]{2}")).select("name", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("name"), F.lit("([a-z]{2,})"), 1))).alias("c"))
    parts = han.select(F.lit(0).alias("part"), F.substring("n", 1, 1).alias("c"))
    parts = parts.unionByName(han.select(F.lit(1).alias("part"), F.explode(F.split(F.expr("substring(n, 2)"), "")).alias("c"))).unionByName(latin.select(F.lit(2).alias("part"), "c"))
    rows = parts.filter("c <> ''").groupBy("part", "c").count().filter("count >= 2").collect()
    of = lambda n: sorted(r["c"] for r in rows if r["part"] == n)
    return NameLetters("".join(of(0)), "".join(of(1)), set(of(2)))


class PersonContexts:
    """Everything that stands in given contexts and could be a name; all contexts are searched by one automaton."""

    def __init__(self, patterns: list[str]):
        import ahocorasick

        self.auto, self.labels = ahocorasick.Automaton(), set()
        anchors: dict[str, list[tuple[str, str, str]]] = {}
        for p in patterns:
            sort, *x = p.split("\t")
            if sort == "C":
                self.labels.add(x[0])
            elif sort == "P":
                anchor = ("before", x[0], x[1]) if len(x[0]) > 1 else ("after", x[1], x[0])
                anchors.setdefault(anchor[1], []).append((anchor[0], anchor[2], p))
            else:
                anchors.setdefault(x[0], []).append(("before" if sort in "Ll" else "after", "", p))
        for a, of in anchors.items():
            self.auto.add_word(a, (a, of))
        if anchors:
            self.auto.make_automaton()
        self.any = bool(anchors)

    def fillers(self, t: str) -> list[tuple[str, int, int]]:
        """(pattern, start, end) of what stands in the contexts."""
        out = []
        if self.any:
            for end, (anchor, of) in self.auto.iter(t):
                start = end + 1 - len(anchor)
                for side, other, p in of:
                    span = self._after(t, end + 1, other) if side == "before" else self._before(t, start, other)
                    if span:
                        out.append((p, *span))
        if self.labels:
            out += [(f"C\t{label}", a, b) for label, a, b in _cells(t) if label in self.labels and (_HAN_CELL.fullmatch(t, a, b) or _LATIN_CELL.fullmatch(t, a, b))]
        return out

    @staticmethod
    def _after(t: str, a: int, right: str) -> tuple[int, int] | None:
        if "A" <= t[a : a + 1] <= "Z" and (m := _LATIN.match(t, a)):
            return m.span() if t.startswith(right, m.end()) else None
        b, letters = a, 0
        while letters < 5 and b < len(t):
            if "一" <= t[b] <= "鿿":
                letters += 1
                b += 1
                if right and 2 <= letters <= 4 and t.startswith(right, b):
                    return a, b
            elif t[b] == " " and letters and b + 1 < len(t) and "一" <= t[b + 1] <= "鿿":
                b += 1
            else:
                break
        whole = 2 <= letters <= 4 and not (b < len(t) and t[b].isalnum()) and not _PLACEHOLDER_LETTERS.match(t, b)
        return (a, b) if whole and not right else None

    @staticmethod
    def _before(t: str, b: int, left: str) -> tuple[int, int] | None:
        lo = max(0, b - 64)
        if b and (t[b - 1] == "." or t[b - 1].isascii() and t[b - 1].isalpha()) and (m := _LATIN_END.search(t[lo:b])):
            return (lo + m.start(), b) if not left or t.endswith(left, 0, lo + m.start()) else None
        a, letters = b, 0
        while letters < 5 and a > 0:
            if "一" <= t[a - 1] <= "鿿":
                letters += 1
                a -= 1
                if left and 2 <= letters <= 4 and t.endswith(left, 0, a):
                    return a, b
            elif t[a - 1] == " " and letters and a > 1 and "一" <= t[a - 2] <= "鿿":
                a -= 1
            else:
                break
        whole = 2 <= letters <= 4 and not (a > 0 and t[a - 1].isalnum())
        return (a, b) if whole and not left else None


_PLACEHOLDER_LETTERS = re.compile(r" ?[A-Z]{1,4}(?![A-Za-z])")
_SEEDED = {"phone": "number", "id_card": "number", "email": "mail", "address": "place"}


class Learned(NamedTuple):
    """The patterns that stand: (slot, kind) to patterns for what has a shape, and the contexts of persons."""

    shaped: dict[str, set[str]]
    people: list[str]


def _patterns_of(t: str, f: Found) -> list[str]:
    return [*(f"S\t{x}" for x in signatures(f.slot, t[f.start : f.end])), *contexts(t, f.start, f.end)]


def first_pass(blocks: DataFrame, key: str, text: str, letters: NameLetters) -> DataFrame:
    """(k, slot, kind, p, i): candidates with a pattern each; for names, their contexts only."""
    kt = blocks.schema[key].dataType.simpleString()
    ship = blocks.sparkSession.sparkContext.broadcast(letters)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who = ship.value
        for pdf in batches:
            rows = set()
            for k, raw in zip(pdf["k"].tolist(), pdf["t"].tolist()):
                t = fold(raw)
                for f in found_shapes(t):
                    i = t[f.start : f.end]
                    rows |= {(k, f.slot, f.kind, p, i) for p in _patterns_of(t, f)}
                for a, b in who.candidates(t):
                    i = t[a:b].replace(" ", "") if "一" <= t[a] <= "鿿" else t[a:b]
                    rows |= {(None, "name", "", p, i) for p in contexts(t, a, b)}
                for label, a, b in _cells(t):
                    if (_HAN_CELL.fullmatch(t, a, b) or _LATIN_CELL.fullmatch(t, a, b)) and who.shaped(t[a:b]):
                        rows.add((None, "name", "", f"C\t{label}", t[a:b]))
            yield pd.DataFrame(list(rows), columns=["k", "slot", "kind", "p", "i"], dtype=object)

    t = blocks.filter((F.length(text) > 0) & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"))
    return t.mapInPandas(run, f"k {kt}, slot string, kind string, p string, i string")


def learn_shapes(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """(kind, p): the patterns of numbers, mails and addresses that stand."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for kind, o in zip(pdf["kind"].tolist(), pdf["original"].tolist()):
                t = fold(o)
                rows += [(f.slot, kind, f"S\t{x}", o) for f in found_shapes(t) for x in signatures(f.slot, t[f.start : f.end])]
            yield pd.DataFrame(rows, columns=["slot", "kind", "p", "i"], dtype=object)

    seeds = entities.filter("kind is not null and original is not null").select("kind", "original").distinct().mapInPandas(read, "slot string, kind string, p string, i string")
    own = F.concat_ws(" ", "slot", "kind").isin([f"{s} {k}" for k, s in _SEEDED.items()])
    seeds = seeds.select("slot", "p", "i", F.when(own, F.col("kind")).otherwise("").alias("kind"), own.alias("known"), F.lit(True).alias("seed"))
    e = cut(edges.filter("slot <> 'name'").select("slot", "p", "i", "kind", F.lit(False).alias("known"), F.lit(False).alias("seed")).union(seeds).distinct())
    # An instance speaks for a kind where it is known, against it where the exact check gives another kind or none, and hardly where unknown.
    own, known = (lambda k: (F.col("kind") == k).cast("long")), (lambda k: ((F.col("kind") == k) & F.col("known")).cast("long"))
    had = -1
    while True:
        of = e.groupBy("slot", "p").agg(F.count("*").alias("n"), *[F.sum(own(k)).alias(f"own_{k}") for k in _SEEDED], *[F.sum(known(k)).alias(f"for_{k}") for k in _SEEDED])
        stands = [F.when(F.expr(f"for_{k} > 0 and for_{k} >= {STANDS} * (for_{k} + n - own_{k} + if(p like 'S%', 0, {UNKNOWN}) * (own_{k} - for_{k}) + {DOUBT})"), F.lit(k)) for k in _SEEDED]
        of = of.select("slot", "p", F.array_compact(F.array(*stands)).alias("of")).filter("size(of) > 0")
        good = cut(e.join(of, ["slot", "p"]).filter("array_contains(of, kind)").select("slot", "kind", "p", "i", "seed"))
        if (now := good.select("slot", "kind", "p").distinct().count()) == had:
            return good.filter("not seed").select("kind", "p").distinct()
        had = now
        reached = good.select("slot", "kind", "i").distinct().withColumn("reached", F.lit(True))
        e = e.join(reached, ["slot", "kind", "i"], "left").select("slot", "p", "i", "kind", (F.col("known") | F.coalesce("reached", F.lit(False))).alias("known"), "seed")


def promising(edges: DataFrame) -> list[str]:
    """All contexts in which a candidate for a name stands; whether persons do, only the second pass can tell, which sees what else stands there."""
    return sorted(r["p"] for r in edges.filter("slot = 'name'").select("p").distinct().collect())


def second_pass(blocks: DataFrame, key: str, text: str, letters: NameLetters, patterns: list[str]) -> DataFrame:
    """(k, p, i, shaped): everything that stands in the contexts, names or not."""
    kt = blocks.schema[key].dataType.simpleString()
    ship = blocks.sparkSession.sparkContext.broadcast((letters, patterns))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, ps = ship.value
        people = PersonContexts(ps)
        for pdf in batches:
            rows = set()
            for k, raw in zip(pdf["k"].tolist(), pdf["t"].tolist()):
                t = fold(raw)
                for p, a, b in people.fillers(t):
                    i = t[a:b].replace(" ", "") if "一" <= t[a] <= "鿿" else t[a:b]
                    rows.add((k, p, i, who.shaped(i)))
            yield pd.DataFrame(list(rows), columns=["k", "p", "i", "shaped"])

    t = blocks.filter((F.length(text) > 0) & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"))
    return t.mapInPandas(run, f"k {kt}, p string, i string, shaped boolean")


def learn_people(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """(p, i): the contexts of persons that stand, from ``second_pass``, and the names that are believed in them."""
    names = _names(entities).select(F.when(F.col("name").rlike("^[一-鿿 ]+$"), F.regexp_replace("name", " ", "")).otherwise(F.col("name")).alias("i")).distinct()
    # Names differ and words repeat, so a context must hold names both by distinct instances and by rows.
    e = edges.groupBy("p", "i", "shaped").agg(F.countDistinct("k").alias("m")).join(names.withColumn("seed", F.lit(True)), "i", "left")
    e = cut(e.select("p", "i", "m", (F.col("shaped") | F.coalesce("seed", F.lit(False))).cast("double").alias("b")))
    seen: list[int] = []
    while True:
        score = e.groupBy("p").agg(F.sum("b").alias("s"), F.count("*").alias("n"), F.sum(F.col("b") * F.col("m")).alias("sm"), F.sum("m").alias("nm"))
        good = score.filter((F.col("s") >= STANDS * (F.col("n") + 2 * DOUBT)) & (F.col("sm") >= STANDS * (F.col("nm") + 2 * DOUBT))).select("p", F.lit(True).alias("good"))
        # What is not made like known names is believed by the share of its rows that stand in good contexts.
        e = cut(e.drop("good").join(good, "p", "left"))
        count = e.filter("good").select("p").distinct().count()
        belief = e.groupBy("i").agg((F.sum(F.when(F.col("good"), F.col("m")).otherwise(0)) / (F.sum("m") + DOUBT)).alias("believed"))
        if count in seen:
            return e.filter("good").join(belief, "i").filter("b = 1 or believed >= 0.5").select("p", "i")
        seen.append(count)
        e = e.join(belief, "i").select("p", "i", "m", F.when(F.col("b") == 1, 1.0).otherwise(F.col("believed")).alias("b"))


def bootstrap(blocks: DataFrame, key: str, text: str, entities: DataFrame) -> DataFrame:
    """(key, kind, p, i) of all instances that stand in good patterns."""
    letters = name_letters(entities)
    first = cut(first_pass(blocks, key, text, letters))
    shapes = learn_shapes(first, entities)
    second = cut(second_pass(blocks, key, text, letters, promising(first)))
    people = learn_people(second, entities)
    rows = first.filter("kind <> ''").join(shapes, ["kind", "p"]).select(F.col("k").alias(key), "kind", "p", "i")
    return rows.unionByName(second.join(people, ["p", "i"]).select(F.col("k").alias(key), F.lit("person").alias("kind"), "p", "i"))


def find_personal(blocks: DataFrame, key: str, text: str, entities: DataFrame) -> DataFrame:
    """(key, kind): the kinds of personal data in each row."""
    return bootstrap(blocks, key, text, entities).select(key, "kind").distinct()


def standing_spans(t: str, found: set[tuple[str, str, str]], people: PersonContexts) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the (kind, pattern, instance) that stand in a folded text, longer ones first where they overlap."""
    out = [(f.start, f.end, f.kind) for f in found_shapes(t) if f.kind and any((f.kind, p, t[f.start : f.end]) in found for p in _patterns_of(t, f))]
    out += [(a, b, "person") for p, a, b in people.fillers(t) if ("person", p, t[a:b].replace(" ", "") if "一" <= t[a] <= "鿿" else t[a:b]) in found]
    if any(k == "address" for _, _, k in out):  # province, town and district go with the street
        whole = [m.span() for m in WHOLE_ADDRESS.finditer(t)]
        out = [next(((x, y, k) for x, y in whole if x <= a and b <= y), (a, b, k)) if k == "address" else (a, b, k) for a, b, k in out]
    kept: list[tuple[int, int, str]] = []
    for a, b, k in sorted(set(out), key=lambda x: (x[2] == "person", x[0] - x[1], x[0])):
        if all(b <= x or a >= y for x, y, _ in kept):
            kept.append((a, b, k))
    return sorted(kept)


def redact(blocks: DataFrame, key: str, text: str, entities: DataFrame) -> DataFrame:
    """(key, redacted): texts with personal data, each finding replaced by its kind's prefix and a letter for each value, the rest unchanged.

    Prefixes are the most frequent ones of the entity table; a kind without any uses that of the detection rules."""
    rows = entities.filter("placeholder_prefix is not null").groupBy("kind", "placeholder_prefix").count().groupBy("kind").agg(F.max_by("placeholder_prefix", "count").alias("p")).collect()
    prefix = {r.kind: r.prefix for r in RULES} | {r["kind"]: r["p"] for r in rows if r["kind"] in SHAPES or r["kind"] == "person"}
    of = bootstrap(blocks, key, text, entities).groupBy(F.col(key).alias("k")).agg(F.collect_set(F.struct("kind", "p", "i")).alias("found"))
    found = blocks.select(F.col(key).alias("k"), F.col(text).alias("t")).dropDuplicates(["k"]).join(of, "k")
    kind = blocks.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for t, found in zip(pdf["t"].tolist(), pdf["found"].tolist()):
                s, at = fold_with_positions(t)
                here = {(x["kind"], x["p"], x["i"]) for x in found}
                people = PersonContexts(sorted({p for k, p, _ in here if k == "person"}))
                names: dict[tuple[str, str], str] = {}
                n: dict[str, int] = {}
                new, last = [], 0
                for a, b, k in standing_spans(s, here, people):
                    v = (k, s[a:b])
                    if v not in names:
                        n[k] = n.get(k, 0) + 1
                        names[v] = prefix[k] + letters(n[k])
                    new += [t[last : at[a]], names[v]]
                    last = at[b - 1] + 1
                out.append("".join([*new, t[last:]]))
            yield pd.DataFrame({"k": pdf["k"], "redacted": out})

    return found.mapInPandas(run, f"k {kind}, redacted string").withColumnRenamed("k", key)


def letters(n: int) -> str:
    s = ""
    while n:
        n, r = divmod(n - 1, 26)
        s = chr(65 + r) + s
    return s
