"""Keyword-stuffed pages, link lists and lists of product tags: robust outliers in the direction of spam.

Each document is measured once: density of running sentences, function words of its middle stretch, repetition and entropy of stretches of
fixed length, and separators and links. Per language, the centre and covariance of the bulk are found by iteration over all documents: from
medians and median deviations, rows within the chi-squared bound are kept, their moments give new distances, until the kept rows stay. The
squared Mahalanobis distance under them decides: a document is spam when it lies ``BOUND`` robust deviations from the bulk, in a direction
within ``ANGLE`` of the one in which outliers with less prose, more repetition and more separators lie. That direction is learned: it starts
from the sides of the measures and moves to the mean of the outliers on its side, until it stays.

Defined results: rows without key, and null, empty and blank texts, have no measures and are never spam; texts are measured whole, and long
ones like short ones; a language that is not known is taken from the script; a language with few documents borrows the covariance that all
languages have within themselves, and one with a single document has no outlier. Only a handful of numbers per language, of fixed count,
comes to the driver.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.session import cut

FEATURES = ["density", "function_words", "repetition", "entropy", "separators"]
#: The side of each measure on which spam lies.
SIDE = np.array([-1.0, -1.0, 1.0, -1.0, 1.0])
#: What a measure cannot tell apart: added to its spread, so that a bulk without any does not make every difference infinite.
GRAIN = np.array([0.02, 0.005, 0.01, 0.05, 0.05])
KEEP = 20.515  # chi-squared, five degrees of freedom, 0.999
#: Squared distance of an outlier that counts, twelve robust deviations; measures have long tails, and prose with a list reaches ten.
BOUND = 144.0
#: Least cosine to the direction of spam.
ANGLE = 0.5
#: Documents that the covariance of all languages counts for.
BORROWED = 20

#: Function words of either language (fixed values).
HAN_FUNCTION = set("的了与在对为由并和将已从按据但且仍该其未至于后及是")
LATIN_FUNCTION = set("the of and to in was is were are be on with that this by so which though as after from but it has had while at a an for or not".split())
#: Characters of a stretch, and of a window that may repeat, in texts of ideographs and in others.
STRETCH, WINDOW = {True: 1024, False: 2560}, {True: 8, False: 16}
#: Least share of function words in a sentence.
SENTENCE = {True: 0.03, False: 0.12}

_ZH_SENTENCE, _EN_SENTENCE = re.compile(r"(?<=[。！？])"), re.compile(r"(?<=[.!?;])\s+")
_WORD = re.compile(r"[^\W\d_]+")
_HAN_RUNS = re.compile("[一-鿿]+")
_HAN_WORDS = re.compile("[" + "".join(sorted(HAN_FUNCTION)) + "]")
_NO_LETTER = re.compile(r"[\W_]+")
#: Without one of these a text has no link.
_LINK_SIGN = re.compile(r"//|[A-Za-z0-9]\.[A-Za-z]")
_LINK = re.compile(r"(?:https?:)?//\S+|\b(?:[a-z0-9-]+\.){1,4}[a-z]{2,12}(?:/\S*)?", re.I)
_SEPARATOR = re.compile(r"[|#【】\[\]\t>·•、；,，]")
_ENDS = frozenset("。！？；，.!?;,")
#: Numbered entries of contents and references: what frames a text and is not judged beside other text.
_ENTRY = re.compile(r"\s*(?:\[\d+\] .*|(?:第[\d零一二三四五六七八九十百]+[章节条]|\d+(?:\.\d+)*[.、)]?)\s[^|#,，/]{1,40})")


def han_count(text: str) -> int:
    return sum(map(len, _HAN_RUNS.findall(text)))


def _codes(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)


def _stretches(a: np.ndarray, length: int) -> list[np.ndarray]:
    return np.array_split(a, max(1, round(len(a) / length)))


def _repetition(text: str, zh: bool) -> float:
    """Share of windows of letters that stand again in the same stretch."""
    h, width, base = _codes(_NO_LETTER.sub("", text.lower())).astype(np.uint64), 1, 1_000_003
    while width < WINDOW[zh]:
        h = h[:-width] * np.uint64(base) + h[width:] if len(h) > width else h[:0]
        width, base = 2 * width, base * base & 0xFFFFFFFFFFFFFFFF
    if not len(h):
        return 0.0
    again = 0
    for x in _stretches(h, STRETCH[zh]):
        x = np.sort(x)
        again += int(np.count_nonzero(x[1:] == x[:-1]))
    return again / len(h)


def _entropy(text: str, zh: bool) -> float:
    """Mean entropy of the characters of stretches, in bits, with the correction for their finite length."""
    total = 0.0
    for x in _stretches(_codes(text), STRETCH[zh]):
        counts = np.unique(x, return_counts=True)[1]
        p = counts / len(x)
        total += -len(x) * float((p * np.log2(p)).sum()) + (len(counts) - 1) / (2 * math.log(2))
    return total / len(text)


def _unframed(text: str) -> str:
    """The text without numbered entries, unless it has little else."""
    rest = "\n".join(x for x in text.splitlines() if not _ENTRY.fullmatch(x))
    return rest if len(rest.strip()) >= 24 else text


def measure(text: str, han: int | None = None) -> tuple[float, ...]:
    """The five measures of one text that is not blank."""
    zh = (han_count(text) if han is None else han) * 6 > len(text)
    text = _unframed(text)
    linked = _LINK_SIGN.search(text) is not None
    total = dense = parted = 0.0
    shares: dict[float, int] = {}
    for line in text.splitlines():
        for p in _ZH_SENTENCE.split(line.strip()) if zh else _EN_SENTENCE.split(line.strip()):
            if not p:
                continue
            n = len(p)
            if zh:
                f = len(_HAN_WORDS.findall(p)) / n
            else:
                w = _WORD.findall(p.lower())
                f = sum(map(LATIN_FUNCTION.__contains__, w)) / len(w) if w else 0.0
            links = sum(map(len, _LINK.findall(p))) if linked and _LINK_SIGN.search(p) else 0
            total += n
            dense += n * (p[-1] in _ENDS and f > SENTENCE[zh])
            parted += n * math.log2((len(_SEPARATOR.findall(p)) + 0.3 * links) / n + 0.01)
            f = round(f, 4)
            shares[f] = shares.get(f, 0) + n
    half, middle = 0, 0.0
    for f, n in sorted(shares.items()):
        half, middle = half + n, f
        if 2 * half >= total:
            break
    return dense / total, middle, _repetition(text, zh), _entropy(text, zh), parted / total


def measures(df: DataFrame, key: str, text: str, lang: str | None = None) -> DataFrame:
    """(key, language, the measures): one row for each row whose text is not blank."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, t, g in zip(pdf["k"].tolist(), pdf["t"].tolist(), pdf["g"].tolist()):
                if t and not t.isspace():
                    han = han_count(t)
                    rows.append((k, "zh" if han * 6 > len(t) else (g or "en") if g != "zh" else "en", *measure(t, han)))
            yield pd.DataFrame(rows, columns=["k", "language", *FEATURES])

    picked = df.select(df[key].alias("k"), df[text].alias("t"), (df[lang] if lang else F.lit(None).cast("string")).alias("g"))
    return picked.filter("k is not null").mapInPandas(run, f"k {kind}, language string, " + ", ".join(f"{f} double" for f in FEATURES)).withColumnRenamed("k", key)


Bulk = dict[str, tuple[np.ndarray, np.ndarray]]


def _by_language(values: dict[str, F.Column]) -> F.Column:
    c = F.lit(None).cast("double")
    for lang, v in values.items():
        c = F.when(F.col("language") == lang, v).otherwise(c)
    return c


def _score(bulk: Bulk) -> list[F.Column]:
    """The whitened measures: the squared distance is the sum of their squares."""
    out = []
    for i in range(len(FEATURES)):
        of = {}
        for lang, (mean, cov) in bulk.items():
            w = np.linalg.cholesky(np.linalg.inv(cov)).T[i]
            of[lang] = sum((F.col(f) - float(m)) * float(x) for f, m, x in zip(FEATURES, mean, w))
        out.append(_by_language(of))
    return out


def _distance(bulk: Bulk) -> F.Column:
    return sum(s * s for s in _score(bulk))


def _moments(m: DataFrame) -> dict[str, tuple[int, np.ndarray, np.ndarray]]:
    """Count, mean and covariance of each language's rows, combined before the shuffle."""
    pairs = [(i, j) for i in range(len(FEATURES)) for j in range(i, len(FEATURES))]
    sums = [F.avg(f).alias(f"m{i}") for i, f in enumerate(FEATURES)] + [F.covar_pop(FEATURES[i], FEATURES[j]).alias(f"c{i}{j}") for i, j in pairs]
    out = {}
    for r in m.groupBy("language").agg(F.count("*").alias("n"), *sums).collect():  # one row for each language
        c = np.zeros((len(FEATURES), len(FEATURES)))
        for i, j in pairs:
            c[i, j] = c[j, i] = r[f"c{i}{j}"]
        out[r["language"]] = r["n"], np.array([r[f"m{i}"] for i in range(len(FEATURES))]), c
    return out


def fit_bulk(m: DataFrame) -> Bulk:
    """Centre and covariance of the bulk of each language: trimmed by distance, again and again, until the same rows are kept."""
    mid = lambda c: F.percentile_approx(c, 0.5, 10000)
    med = {r["language"]: r for r in m.groupBy("language").agg(*[mid(f).alias(f) for f in FEATURES]).collect()}
    if not med:
        return {}
    off = [F.abs(F.col(f) - _by_language({g: F.lit(float(r[f])) for g, r in med.items()})).alias(f) for f in FEATURES]
    mad = {r["language"]: r for r in m.select("language", *off).groupBy("language").agg(*[mid(f).alias(f) for f in FEATURES]).collect()}
    bulk = {g: (np.array([r[f] for f in FEATURES]), np.diag(np.array([1.4826 * mad[g][f] for f in FEATURES]) ** 2 + GRAIN**2)) for g, r in med.items()}
    kept: list[dict[str, int]] = []
    while True:
        now = _moments(m.filter(_distance(bulk) <= KEEP))
        counts = {g: n for g, (n, _, _) in now.items()}
        if counts in kept:  # the same rows, or a cycle of nearly the same
            return bulk
        kept.append(counts)
        pooled = sum(n * c for n, _, c in now.values()) / sum(counts.values())
        bulk = {g: (mean, (n * c + BORROWED * pooled) / (n + BORROWED) + np.diag(GRAIN**2)) for g, (n, mean, c) in now.items()} | {g: b for g, b in bulk.items() if g not in now}


def spam_directions(m: DataFrame, bulk: Bulk) -> dict[str, np.ndarray]:
    """The whitened unit vector of each language in which its spam lies, learned from its outliers."""
    out = {}
    for g, (_, cov) in bulk.items():
        u = np.linalg.cholesky(np.linalg.inv(cov)).T @ (SIDE * np.sqrt(np.diag(cov)))
        out[g] = u / np.linalg.norm(u)
    names = [f"w{i}" for i in range(len(FEATURES))]
    far = cut(m.select("language", *[s.alias(n) for s, n in zip(_score(bulk), names)]).withColumn("d", F.sqrt(sum(F.col(n) * F.col(n) for n in names))).filter(F.col("d") > math.sqrt(BOUND)))
    for _ in range(20):
        along = sum(F.col(n) * _by_language({g: F.lit(float(u[i])) for g, u in out.items()}) for i, n in enumerate(names))
        new = {}
        for r in far.filter(along > 0).groupBy("language").agg(*[F.avg(F.col(n) / F.col("d")).alias(n) for n in names]).collect():
            v = np.array([r[n] for n in names])
            new[r["language"]] = v / np.linalg.norm(v)
        moved = max((float(np.abs(v - out[g]).max()) for g, v in new.items()), default=0.0)
        out |= new
        if moved < 1e-6:
            break
    return out


def find_spam(df: DataFrame, key: str, text: str, lang: str | None = None) -> DataFrame:
    """(key, language, d2, cosine, the measures, spam) for each text that is not blank."""
    m = cut(measures(df, key, text, lang))
    bulk = fit_bulk(m)
    if not bulk:
        return m.select(key, "language", F.lit(0.0).alias("d2"), F.lit(0.0).alias("cosine"), *FEATURES, F.lit(False).alias("spam"))
    to = spam_directions(m, bulk)
    d2 = _distance(bulk)
    along = sum(s * _by_language({g: F.lit(float(u[i])) for g, u in to.items()}) for i, s in enumerate(_score(bulk)))
    x = m.withColumn("d2", d2).withColumn("cosine", F.when(d2 > 0, along / F.sqrt(d2)).otherwise(0.0))
    return x.select(key, "language", "d2", "cosine", *FEATURES, ((F.col("d2") > BOUND) & (F.col("cosine") > ANGLE)).alias("spam"))
