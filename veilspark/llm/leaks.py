"""Passages of test items inside a corpus, by greedy string tiling.

Texts are compared without case, width, spacing, line breaks and punctuation. A document and an item that share seeds (windows of
``SEED`` characters, found by running Karp-Rabin hashes against a bitmap of all items' windows) are tiled: the longest common stretch
that is not yet covered is marked, again and again, down to ``LEAST`` characters. Tiles that lie close together in the document form a
passage; swapped words leave short gaps, reordered sentences change nothing. The item leaked when one dense passage covers at least
a third of it; dense means that most of the passage, from its first to its last tile, is tiled. Tiles that keep the item's order are enough;
in another order, texts of the same style reach a third by phrases that many items share, so the passage must hold its part of what tells
the item from others as well: each window of the item counts by its rarity among the items.

Defined results: rows without key, and null, empty and blank texts on either side, give no pair; repeated rows give one pair; documents are read whole. Items
go to the workers in blocks of bounded size, each block against all documents, so any number of items can be asked for.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Seed and least tile in characters, for texts mainly of ideographs and for others; gap that a passage may bridge.
SEED = {"han": 8, "other": 16}
LEAST = {"han": 4, "other": 9}
GAP = {"han": 14, "other": 36}
DENSE = 0.74
#: Share of the item that a passage must cover, and share of the item's information that it must hold where its tiles leave the order.
COVER, INFORMATION = 1 / 3, 0.28
#: Pairs of equal windows from which tiles are searched by length; the tiles are the same.
MANY = 20_000
#: Characters of items that one block holds at most; a block's index is broadcast.
BLOCK_CHARS = 4_000_000

_DROP = re.compile(r"[\W_]+")
_BASE = 1_000_003
#: Bits of a slot at most: a bitmap has sixteen slots for each window of its items up to 32 MB.
_MOST_BITS = 25


def plain(text: str) -> str:
    """The text without what may differ."""
    return _DROP.sub("", unicodedata.normalize("NFKC", text).casefold())


def script(s: str) -> str:
    return "han" if sum(map("一".__le__, s)) * 2 > len(s) else "other"


def running_hashes(s: str) -> dict[str, np.ndarray]:
    """Karp-Rabin hashes of all windows of either seed length, by doubling."""
    h = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    out, width, base = {}, 1, _BASE
    while width < 16:
        h = h[:-width] * np.uint64(base) + h[width:] if len(h) > width else h[:0]
        width *= 2
        base = base * base & 0xFFFFFFFFFFFFFFFF
        if width in (8, 16):
            out["han" if width == 8 else "other"] = h
    return out


def _slot(h: np.ndarray, bits: int) -> np.ndarray:
    return ((h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int64)


def _prefix_sums(s: str) -> tuple[np.ndarray, np.ndarray]:
    """Sums from which the hash of any window follows, in the ring of 64 bits, and the inverse powers that go with them."""
    c = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    power, inverse = np.full(len(c) + 1, _BASE, np.uint64), np.full(len(c) + 1, pow(_BASE, -1, 1 << 64), np.uint64)
    power[0] = inverse[0] = 1
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(c * np.cumprod(power)[:-1])]), np.cumprod(inverse)


def _free_windows(sums: tuple[np.ndarray, np.ndarray], covered: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the windows of ``n`` characters none of which is covered."""
    total, inverse = sums
    marks = np.concatenate([[0], np.cumsum(covered)])
    at = np.flatnonzero(marks[n:] == marks[:-n])
    return at, (total[at + n] - total[at]) * inverse[at]


def tiles_by_length(a: str, b: str, least: int) -> list[tuple[int, int, int]]:
    """The tiles of ``tiles``, for texts that repeat themselves: the greatest length with a match is searched by halves, its matches are marked."""
    sa, sb = _prefix_sums(a), _prefix_sums(b)
    ca, cb, out, most = np.zeros(len(a), bool), np.zeros(len(b), bool), [], min(len(a), len(b))

    def matches(n: int):
        (i, h), (j, g) = _free_windows(sa, ca, n), _free_windows(sb, cb, n)
        keep = np.isin(h, g)
        return i[keep], h[keep], j, g

    while most >= least:
        lo, hi = least - 1, most
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if len(matches(mid)[0]) else (lo, mid - 1)
        if lo < least:
            break
        i, h, j, g = matches(lo)
        where: dict[int, list[int]] = defaultdict(list)
        for x, y in zip(j[::-1].tolist(), g[::-1].tolist()):
            where[y].append(x)
        end = 0
        for x, y in zip(i.tolist(), h.tolist()):
            js = where[y]
            while js and cb[js[-1] : js[-1] + lo].any():
                js.pop()
            if x >= end and js:
                z = js.pop()
                ca[x : x + lo] = cb[z : z + lo] = True
                out.append((x, z, lo))
                end = x + lo
        most = lo - 1
    return sorted(out)


def tiles(a: str, b: str, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiling of (start in a, start in b, length): the longest stretch not yet covered in either text first; ties in order of a, then b."""
    where = defaultdict(list)
    for j in range(len(b) - least + 1):
        where[b[j : j + least]].append(j)
    if sum(len(where.get(a[i : i + least], ())) for i in range(len(a) - least + 1)) > MANY:
        return tiles_by_length(a, b, least)
    found = []
    for i in range(len(a) - least + 1):
        for j in where.get(a[i : i + least], ()):
            if i and j and a[i - 1] == b[j - 1]:
                continue
            k = least
            while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
                k += 1
            found.append((-k, i, j))
    found.sort()
    ca, cb, out = np.zeros(len(a), bool), np.zeros(len(b), bool), []
    while found:
        later, length = [], found[0][0]
        for n, i, j in found:
            k = -n
            free = ~(ca[i : i + k] | cb[j : j + k])
            if n != length:
                later.append((n, i, j))
            elif free.all():
                ca[i : i + k] = cb[j : j + k] = True
                out.append((i, j, k))
            else:  # the parts that are left compete again
                edge = np.flatnonzero(np.diff(np.concatenate([[0], free.view(np.int8), [0]])))
                later += [(-(y - x), i + int(x), j + int(x)) for x, y in zip(edge[::2], edge[1::2]) if y - x >= least]
        found = sorted(later)
    return sorted(out)


def best_passage(t: list[tuple[int, int, int]], gap: int, size: float, told=None, ordered: bool = False) -> float:
    """How well the best passage that is dense and has no wide gaps does what is needed, 1 being enough: cover of ``size`` characters, and,
    where ``told`` gives the information of a stretch of the item, its part of that. With ``ordered``, passages keep the item's order."""
    best, n = 0.0, len(t)
    for x in range(n):
        covered, held, last, at = 0, 0.0, t[x][0], t[x][1]
        for y in range(x, n):
            i, j, k = t[y]
            if i - last > gap or ordered and not -2 <= j - at <= gap:
                break
            covered, last, at = covered + k, i + k, j + k
            held += told(j, k) if told else 0.0
            if covered >= DENSE * (last - t[x][0]):
                best = max(best, min(covered / (COVER * size), held / INFORMATION) if told else covered / (COVER * size))
    return best


class ItemIndex:
    """The seeds of a block of items."""

    def __init__(self, items: list[tuple[int, str]]):
        self.text = {k: s for k, t in items if (s := plain(t))}
        self.kind = {k: script(s) for k, s in self.text.items()}
        self.short = {k for k, s in self.text.items() if len(s) < 2 * SEED[self.kind[k]]}
        size = {g: sum(len(s) for k, s in self.text.items() if self.kind[k] == g) for g in SEED}
        self.bits = {g: min(_MOST_BITS, max(16, (16 * n).bit_length())) for g, n in size.items()}
        self.bitmap = {g: np.zeros(1 << n, bool) for g, n in self.bits.items()}
        posted: dict[str, dict[int, set[int]]] = {g: defaultdict(set) for g in SEED}
        for k, s in self.text.items():
            h = running_hashes(s)[self.kind[k]]
            self.bitmap[self.kind[k]][_slot(h, self.bits[self.kind[k]])] = True
            for x in h.tolist():
                posted[self.kind[k]][x].add(k)
        self.posted = {g: {x: tuple(v) for x, v in p.items()} for g, p in posted.items()}
        self.told = {k: w for g in SEED for k, w in self._rarities(g).items()}

    def _rarities(self, g: str) -> dict[int, np.ndarray]:
        """Running sums of the rarity of each item's least windows among the items, as shares of their total."""
        of = {k: _free_windows(_prefix_sums(s), np.zeros(len(s), bool), LEAST[g])[1] for k, s in self.text.items() if self.kind[k] == g and len(s) >= LEAST[g]}
        if not of:
            return {}
        known, times = np.unique(np.concatenate([np.unique(h) for h in of.values()]), return_counts=True)
        rare = 1 - np.log(times) / math.log(max(2, len(of)))
        out = {}
        for k, h in of.items():
            w = np.concatenate([[0.0], np.cumsum(rare[np.searchsorted(known, h)])])
            # A stretch counts by the mean of its windows; where all windows are shared by all items, all count alike.
            out[k] = w / w[-1] * len(h) if w[-1] > 0 else np.arange(len(h) + 1.0)
        return out

    def part(self, k: int, start: int, length: int) -> float:
        """Share of item ``k``'s information in a stretch of it."""
        w, m = self.told[k], length - LEAST[self.kind[k]] + 1
        return float(w[start + m] - w[start]) / m * length / len(self.text[k])

    def leaks(self, text: str) -> list[tuple[int, float]]:
        """(item, cover by the best passage in terms of what is needed) of the items that leaked."""
        s = plain(text)
        hits: dict[int, list[int]] = defaultdict(list)
        for g, h in running_hashes(s).items():
            if not len(h):
                continue
            at = np.flatnonzero(self.bitmap[g][_slot(h, self.bits[g])])
            posted = self.posted[g]
            for p, x in zip(at.tolist(), h[at].tolist()):
                for k in posted.get(x, ()):
                    hits[k].append(p)
        out = []
        for k, ps in hits.items():
            item, g = self.text[k], self.kind[k]
            if len(ps) < 0.07 * len(item):
                continue
            # Stretches of the document around seeds, each at most as far from the next as the item is long.
            reach, best = len(item) + GAP[g], 0.0
            a = 0
            for z in range(1, len(ps) + 1):
                if z == len(ps) or ps[z] - ps[z - 1] > reach:
                    if z - a >= 0.07 * len(item):
                        lo, hi = max(0, ps[a] - GAP[g]), ps[z - 1] + SEED[g] + GAP[g]
                        t = tiles(s[lo:hi], item, LEAST[g])
                        best = max(best, best_passage(t, GAP[g], len(item), ordered=True), best_passage(t, GAP[g], len(item), lambda j, n, k=k: self.part(k, j, n)))
                    a = z
            if best >= 1:
                out.append((k, best))
        for k in self.short:
            if self.text[k] in s:
                out.append((k, 2.5))
        return out


def _blocks(items: DataFrame, key: str, text: str) -> Iterator[list[tuple[int, str]]]:
    """The items, a bounded block at a time."""
    block, size = [], 0
    for r in items.select(key, text).dropna().dropDuplicates([key]).toLocalIterator():
        block.append((r[0], r[1]))
        size += len(r[1])
        if size >= BLOCK_CHARS:
            yield block
            block, size = [], 0
    yield block


def find_leaks(docs: DataFrame, doc_key: str, doc_text: str, items: DataFrame, item_key: str, item_text: str) -> DataFrame:
    """(doc key, item key, share): the items of which a document holds a passage; share is the cover in terms of what is needed."""
    dk, ik = docs.schema[doc_key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    picked = docs.select(docs[doc_key].alias("d"), docs[doc_text].alias("t")).filter("d is not null")
    out = None
    for block in _blocks(items, item_key, item_text):
        ship = docs.sparkSession.sparkContext.broadcast(ItemIndex(block))

        def run(batches: Iterator[pd.DataFrame], ship=ship) -> Iterator[pd.DataFrame]:
            index = ship.value
            for pdf in batches:
                rows = [(d, k, c) for d, t in zip(pdf["d"].tolist(), pdf["t"].tolist()) if t for k, c in index.leaks(t)]
                yield pd.DataFrame(rows, columns=["d", "i", "share"])

        one = picked.mapInPandas(run, f"d {dk}, i {ik}, share double")
        out = one if out is None else out.unionByName(one)
    return out.groupBy(F.col("d").alias(doc_key), F.col("i").alias(item_key)).agg(F.max("share").alias("share"))
