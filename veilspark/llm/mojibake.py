"""Text decoded with the wrong character encoding: finding it and restoring the original where it can be.

Round-trip repair: runs of unusual characters are encoded under each candidate legacy encoding and strictly decoded as the intended
encoding; a reading is accepted when the garbling cost of the text drops by more than ``MARGIN`` bits, and the search repeats on the
result, for texts garbled in layers. The cost of a character is its surprise under the character counts of the whole corpus, which
are bounded by the size of Unicode and so may be broadcast. A text also counts as garbled, restorable or not, when it holds
replacement characters, C1 controls or private-use characters, which decoding errors leave behind.

Defined results: rows without key give none; null and empty texts are never garbled and come out as they are; text that only holds foreign scripts stays as it is;
a text of which a part can be restored comes out with that part restored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.functions.chars import shows_nothing

#: Encodings with which bytes are wrongly read, and encodings in which they were written (fixed values).
LEGACY = ["cp1252", "mac_roman", "cp437", "cp850", "cp866", "koi8_r", "cp1251", "gb18030", "big5", "cp932", "cp949", "euc_jp"]
INTENDED = ["utf-8", "gb18030"]
MARGIN = 8.0
#: Mean and greatest surprise, in bits, of a plausible reading as a legacy multi-byte encoding, whose strict decoding says little.
PLAUSIBLE_MEAN, PLAUSIBLE_MAX = 12.5, 19.0
#: Mean surprise up to which a strict reading as UTF-8 stands: the corpus knows its characters.
FOREIGN_MEAN = 18.5
#: Bits by which each character must fall where two-byte characters stand for as many letters; they must fill their run, between ASCII characters.
LETTER_DROP = 4.0
#: A character at least as frequent as this, of the scripts in ``_everyday``, needs no look.
EVERYDAY = 5e-5

_UTF8 = re.compile(rb"(?:[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2})+")
_TRACE = re.compile("[�\x80-\x84\x86-\x9f-\U000f0000-\U0010ffff]")
_RUN = re.compile(r"[^\x00-\x7f]+")


def character_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(c, n): counts of all characters of the columns, over all rows; counted in each partition before the shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        for pdf in batches:
            for c in columns:
                total.update("".join(x for x in pdf[c] if x))
        yield pd.DataFrame(total.items(), columns=["c", "n"], dtype=object)

    return df.select(*columns).mapInPandas(run, "c string, n long").groupBy("c").agg(F.sum("n").alias("n"))


def _everyday(c: str) -> bool:
    n = ord(c)
    if n < 0x80 or 0x3001 <= n <= 0x3017 or 0xFF01 <= n <= 0xFF5E or 0x2010 <= n <= 0x2027:
        return True
    if 0x4E00 <= n <= 0x9FFF:
        try:
            return bool(c.encode("gb2312"))
        except UnicodeEncodeError:
            return False
    return False


class GarbleModel:
    """Character costs and the repair; small enough to go to every worker."""

    def __init__(self, counts: dict[str, int]):
        total = sum(counts.values()) + 1
        self.unseen = math.log2(total + 2) + 2
        self.cost = {c: math.log2(total / n) for c, n in counts.items()}
        self.common = frozenset(c for c, n in counts.items() if n >= EVERYDAY * total and _everyday(c)) | frozenset(chr(n) for n in range(128))
        self.common |= frozenset(chr(n) for n in range(0x80, 0x10000) if shows_nothing(chr(n)) or chr(n).isspace() and n > 0x9F)
        self._bytes: dict[str, dict[str, bytes | None]] = {e: {} for e in LEGACY}
        self._known: dict[str, dict[tuple[str, str], tuple[str, float]]] = {}

    def price(self, s: str) -> float:
        get, unseen = self.cost.get, self.unseen
        return sum(get(c, unseen) for c in s)

    def _encode(self, c: str, legacy: str) -> bytes | None:
        known = self._bytes[legacy]
        if c in known:
            return known[c]
        try:
            b = c.encode(legacy)
        except UnicodeEncodeError:
            b = bytes([ord(c)]) if legacy == "cp1252" and 0x80 <= ord(c) <= 0x9F else None
        known[c] = b
        return b

    def _read(self, run: str, legacy: str, intended: str) -> tuple[str, float]:
        """The run with the parts that can be read otherwise, and by how much its cost drops."""
        parts = [self._encode(c, legacy) for c in run]
        out, gain, i, n = [], 0.0, 0, len(run)
        while i < n:
            if parts[i] is None or parts[i][0] < 0x80:
                out.append(run[i])
                i += 1
                continue
            j = i
            while j < n and parts[j] is not None:
                j += 1
            piece, got = (self._utf8 if intended == "utf-8" else self._legacy)(run[i:j], parts[i:j], intended)
            out.append(piece)
            gain += got
            i = j
        return "".join(out), gain

    def _utf8(self, s: str, parts: list[bytes], _: str) -> tuple[str, float]:
        data, starts, at = b"".join(parts), {}, 0
        for k, p in enumerate(parts):
            starts[at] = k
            at += len(p)
        starts[at] = len(parts)
        out, gain, done, order = [], 0.0, 0, list(starts)
        for m in _UTF8.finditer(data):
            a, b = m.span()
            if a not in starts or b not in starts:
                # The match must begin and end where characters do; a character has four bytes at most.
                lo, hi = bisect_left(order, a), bisect_right(order, b)
                fit = next(((x, y) for x in order[lo : min(hi, lo + 4)] for y in reversed(order[max(lo, hi - 4) : hi]) if y > x and self._whole(data[x:y])), None)
                if fit is None:
                    continue
                a, b = fit
            k0, k1 = starts[a], starts[b]
            if k0 < done:
                continue
            new = data[a:b].decode("utf-8")
            drop = self.price(s[k0:k1]) - self.price(new)
            if k1 - k0 == len(new) and max(map(len, parts[k0:k1])) > 1 and (drop < LETTER_DROP * len(new) or k1 - k0 < len(s) or not all(c.isalpha() or c in "°±µ" for c in new)):
                continue  # known ideographs for letters, of two bytes each: chance
            if drop > 0 and self.price(new) <= FOREIGN_MEAN * len(new) and not any(unicodedata.category(c) in ("Cc", "Cn", "Co", "Cs") and c != "\n" for c in new if not "\x80" <= c <= "\x9f"):
                out += [s[done:k0], new]
                gain += drop
                done = k1
        out.append(s[done:])
        return "".join(out), gain

    @staticmethod
    def _whole(b: bytes) -> bool:
        return _UTF8.fullmatch(b) is not None

    def _legacy(self, s: str, parts: list[bytes], intended: str) -> tuple[str, float]:
        if sum(map(self.common.__contains__, s)) > 0.3 * len(s) or 2 * sum(map(_everyday, s)) > len(s):
            return s, 0.0  # plausible as it stands
        try:
            new = b"".join(parts).decode(intended)
        except UnicodeDecodeError:
            return s, 0.0
        if new == s or len(new) < 2:
            return s, 0.0
        each = [self.cost.get(c, self.unseen) for c in new]
        if sum(each) / len(each) > PLAUSIBLE_MEAN or max(each) > PLAUSIBLE_MAX:
            return s, 0.0
        drop = self.price(s) - sum(each)
        return (new, drop) if drop > 0 else (s, 0.0)

    def _readings(self, run: str) -> dict[tuple[str, str], tuple[str, float]]:
        """The readings of a run under which its cost drops."""
        if (known := self._known.get(run)) is not None:
            return known
        odd, out = [c for c in run if c not in self.common], {}
        for legacy in LEGACY:
            if not any((b := self._encode(c, legacy)) and b[0] >= 0x80 for c in odd):
                continue
            for intended in INTENDED:
                if legacy != intended:
                    new, gain = self._read(run, legacy, intended)
                    if gain > 0:
                        out[legacy, intended] = new, gain
        if len(run) <= 64:
            if len(self._known) > 200_000:
                self._known.clear()
            self._known[run] = out
        return out

    def _layer(self, text: str) -> str | None:
        """The text with its best reading, if that lowers its cost by more than the margin."""
        runs = [m for m in _RUN.finditer(text) if not self.common.issuperset(m.group())]
        total: dict[tuple[str, str], float] = {}
        for m in runs:
            for k, (_, gain) in self._readings(m.group()).items():
                total[k] = total.get(k, 0.0) + gain
        if not total or total[best := max(total, key=total.get)] <= MARGIN:
            return None
        out, at = [], 0
        for m in runs:
            if r := self._readings(m.group()).get(best):
                out += [text[at : m.start()], r[0]]
                at = m.end()
        return "".join([*out, text[at:]])

    def _through(self, text: str) -> str | None:
        """The text behind two layers or more of one encoding whose intermediate readings no corpus knows, if it is cheaper by the margin."""
        if min(map(len, _RUN.findall(text)), default=0) < 4:
            return None  # a character of two layers has four at least
        best, least = None, self.price(text) - MARGIN
        for legacy in LEGACY:
            now, layers = text, 0
            while not now.isascii():
                try:
                    new = _RUN.sub(lambda m: b"".join(self._encode(c, legacy) or b"\xff" for c in m.group()).decode("utf-8"), now)  # noqa: B023
                except UnicodeDecodeError:
                    break
                now, layers = new, layers + 1
                if layers > 1 and (cost := self.price(now)) < least and cost <= FOREIGN_MEAN * len(now):
                    best, least = now, cost
        return best

    def repair(self, text: str | None, restore: bool = True) -> tuple[bool, str | None]:
        """(garbled, text as far as it can be restored); without ``restore`` the search ends as soon as the answer is known."""
        if not text or text.isascii() or self.common.issuperset(text):
            return False, text
        garbled, now = _TRACE.search(text) is not None, text
        if garbled and not restore:
            return True, None
        while (new := self._through(now) or self._layer(now)) is not None:  # each layer lowers the cost by the margin, so this ends
            garbled, now = True, new
            if not restore:
                return True, None
        return garbled, now


def fit_model(df: DataFrame, columns: list[str]) -> GarbleModel:
    """Counts over all rows; at most one entry for each code point of Unicode comes to the driver."""
    return GarbleModel({r["c"]: r["n"] for r in character_counts(df, columns).collect()})


def repair_columns(df: DataFrame, key: str, columns: list[str], model: GarbleModel | None = None, restore: bool = True) -> DataFrame:
    """(key, field, restored) for each row and column with a garbled value; ``restored`` is null where it is not asked for."""
    model = model or fit_model(df, columns)
    ship = df.sparkSession.sparkContext.broadcast(model)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, seen = ship.value, {}
        for pdf in batches:
            out = []
            keys = pdf["k"].tolist()
            for i, c in enumerate(columns):
                for k, t in zip(keys, pdf[f"c{i}"].tolist()):
                    if not t:
                        continue
                    if len(t) < 80:
                        if t not in seen:
                            if len(seen) > 100_000:
                                seen.clear()
                            seen[t] = m.repair(t, restore)
                        bad, new = seen[t]
                    else:
                        bad, new = m.repair(t, restore)
                    if bad:
                        out.append((k, c, new))
            yield pd.DataFrame(out, columns=["k", "field", "restored"])

    picked = df.select(df[key].alias("k"), *[df[c].alias(f"c{i}") for i, c in enumerate(columns)])
    return picked.filter("k is not null").mapInPandas(run, f"k {kind}, field string, restored string").withColumnRenamed("k", key)
