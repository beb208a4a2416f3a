"""Replacement of values in texts, and its inverse.

Values claim text longest first, so parts of a longer value are never replaced on their own; a value is searched left to right and goes on
behind each hit, also where the hit was already claimed. Every text meets only those of its project's values that it can hold: values are
joined with texts on their rarest gram, then found exactly, and claimed in each text.

Defined results: null and empty texts stay; values of null or no length claim nothing; of equal long values the one listed first wins."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.session import cut, spread

#: Characters of a gram; shorter values are grams of their own length.
GRAM = 4
#: The bitmap that screens the grams of texts has 16 MB at most, whatever the number of values.
MOST_SLOT_BITS = 27
#: Odd factors, one for each slot of an anchor: with four slots of sixteen one gram in 400 passes by chance, with one slot one in 16.
PROBES = [1, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F]
#: Counters of grams: 4 MB.
COUNTER_BITS = 20


def claim_spans(text: str, pairs: list[tuple[str, str]]) -> list[tuple[int, int, str]]:
    """(start, end, replacement) of the hits that claim their text, in order of the text; ``pairs`` must be longest first."""
    return _claim(text, pairs, {o: _occurrences(text, o) for o, _ in pairs})


def _occurrences(text: str, value: str) -> list[int]:
    out, at = [], text.find(value)
    while at >= 0:
        out.append(at)
        at = text.find(value, at + len(value))
    return out


def _claim(text: str, pairs: list[tuple[str, str]], at: dict[str, list[int]]) -> list[tuple[int, int, str]]:
    taken, out = bytearray(len(text)), []
    for original, new in pairs:
        for a in at.get(original, ()):
            b = a + len(original)
            if not any(taken[a:b]):
                taken[a:b] = b"\x01" * (b - a)
                out.append((a, b, new))
    return sorted(out)


def apply_spans(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, b, new in spans:
        out += [text[at:a], new]
        at = b
    return "".join([*out, text[at:]])


class Replacer:
    """One project's values, searched together."""

    def __init__(self, pairs: list[tuple[str, str]]):
        seen: dict[str, str] = {}
        for original, new in pairs:
            if original and original not in seen:
                seen[original] = new
        self.pairs = sorted(seen.items(), key=lambda p: -len(p[0]))
        self.auto = None
        if self.pairs:
            import ahocorasick

            self.auto = ahocorasick.Automaton()
            for i, (o, _) in enumerate(self.pairs):
                self.auto.add_word(o, i)
            self.auto.make_automaton()

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        if self.auto is None:
            return []
        at: dict[str, list[int]] = {}
        for end, i in self.auto.iter(text):
            o = self.pairs[i][0]
            a, known = end - len(o) + 1, at.setdefault(o, [])
            if not known or a >= known[-1] + len(o):
                known.append(a)
        return _claim(text, [p for p in self.pairs if p[0] in at], at)

    def __call__(self, text: str | None) -> str | None:
        return apply_spans(text, self.spans(text)) if text else text


def grams(strings: list[str], seeds: np.ndarray, sizes: list[int] | None = None, only: set[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the windows of 1 to ``GRAM`` characters of each string under its seed; with ``sizes``, of one size for each string,
    and with ``only``, of these sizes."""
    codes = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    length = np.fromiter(map(len, strings), np.int64, len(strings))
    row = np.repeat(np.arange(len(strings)), length)
    left = np.repeat(np.cumsum(length), length) - np.arange(len(codes))  # characters from here to the end of the string
    seed = seeds.view(np.uint64)[row] if len(row) else codes
    rows, hashes, h = [], [], seed
    for size in range(1, GRAM + 1):
        n = len(codes) - size + 1
        if n <= 0:
            break
        h = h.copy()
        h[:n] = h[:n] * np.uint64(1_000_003) + codes[size - 1 :]
        if only is not None and size not in only:
            continue
        keep = left >= size
        if sizes is not None:
            keep &= np.array(sizes)[row] == size
        x = (h[keep] + np.uint64(size)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        rows.append(row[keep])
        hashes.append(x ^ (x >> np.uint64(32)))
    return np.concatenate([row[:0], *rows]), np.concatenate([codes[:0], *hashes])


def _gathered(parts: DataFrame, out: np.ndarray, merge: Callable[[pd.Series], np.ndarray]) -> np.ndarray:
    """``out`` with the blocks of (block, part), each merged by an executor: no more comes to the driver, whatever the number of parts."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "part": [merge(pdf["part"]).tobytes()]})

    for r in parts.groupBy("block").applyInPandas(run, "block int, part binary").toLocalIterator():
        one = np.frombuffer(r["part"], out.dtype)
        out[r["block"] * len(one) : (r["block"] + 1) * len(one)] = one
    return out


def _counters(values: DataFrame) -> np.ndarray:
    """About how often each gram stands in the values of a project, in counters of fixed number that grams share."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(1 << COUNTER_BITS, np.int64)
        for pdf in batches:
            n += np.bincount(_counter(_own_grams(pdf["v"].tolist(), pdf["s"])[1]), minlength=len(n))
        blocks = n.clip(max=2**32 - 1).astype(np.uint32).reshape(-1, 1 << 12)
        at = np.flatnonzero(blocks.any(axis=1))
        yield pd.DataFrame({"block": at, "part": [blocks[i].tobytes() for i in at]})

    def merge(parts: pd.Series) -> np.ndarray:
        return sum(np.frombuffer(x, np.uint32).astype(np.int64) for x in parts).clip(max=2**32 - 1).astype(np.uint32)

    return _gathered(values.select("v", "s").mapInPandas(run, "block int, part binary"), np.zeros(1 << COUNTER_BITS, np.uint32), merge)


def _own_grams(values: list[str], seeds: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    return grams(values, seeds.to_numpy(), [min(GRAM, len(v)) for v in values])


def _counter(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)


def _anchors(values: DataFrame) -> DataFrame:
    """The values (p, v, s, m) with ``h``, the rarest gram of each by the counters; every text that holds the value has it too.

    The counters may err, which costs time only: any gram of a value is in all texts that hold it."""
    ship = values.sparkSession.sparkContext.broadcast(_counters(values))

    def rarest(v: pd.Series, s: pd.Series) -> pd.Series:
        row, h = _own_grams(v.tolist(), s)
        order = np.lexsort((h, ship.value[_counter(h)], row))
        return pd.Series(h[order][np.unique(row[order], return_index=True)[1]].view(np.int64))

    return values.withColumn("h", F.pandas_udf(rarest, "long").asNondeterministic()("v", "s"))  # so that no filter computes it again


def _slots(h: np.ndarray, probe: int, width: int) -> np.ndarray:
    return ((h * np.uint64(PROBES[probe])) >> np.uint64(64 - width)).astype(np.int64)


def _bitmap(anchors: DataFrame, many: int) -> tuple[int, np.ndarray]:
    """(bits of a slot, which slots the anchors take): sixteen slots an anchor up to ``2 ** MOST_SLOT_BITS``, so its size is bounded. Each
    anchor takes a slot by each of ``PROBES``; executors merge the blocks."""
    width = min(MOST_SLOT_BITS, max(16, (16 * many).bit_length()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            h = pdf["h"].to_numpy().view(np.uint64)
            slots = np.unique(np.concatenate([_slots(h, k, width) for k in range(len(PROBES))]))
            blocks, at = np.unique(slots >> 16, return_index=True)
            yield pd.DataFrame({"block": blocks, "part": [x.astype(np.uint16).tobytes() for x in np.split(slots & 0xFFFF, at[1:])]})

    def merge(parts: pd.Series) -> np.ndarray:
        taken = np.zeros(1 << 16, bool)
        for x in parts:
            taken[np.frombuffer(x, np.uint16)] = True
        return np.packbits(taken, bitorder="little")

    return width, _gathered(anchors.select("h").mapInPandas(run, "block int, part binary"), np.zeros(1 << width - 3, np.uint8), merge)


def _candidates(texts: DataFrame, values: DataFrame, project: str, text: str, value: str, more: list[str]) -> tuple[DataFrame, DataFrame]:
    """The texts with ``_id``, and by (i, ap), their id and project, an array ``_found`` of (value, m), m the rows (*more) of the value: all
    values that they can hold, few that they do not.

    Values meet texts on their rarest gram. A text's grams are screened by a bitmap of fixed size before they travel, so what is shuffled
    follows the texts and their hits, not texts times values; values never go where no text can hold them."""
    v = values.filter(F.length(value) > 0).groupBy(F.col(project).alias("p"), F.col(value).alias("v")).agg(F.collect_list(F.struct(F.lit(0).alias("_"), *more)).alias("m"))
    v = cut(v.withColumn("s", F.xxhash64("p")))
    anchors = _anchors(v)
    many = v.agg(F.count("*").alias("n"), F.collect_set(F.least(F.length("v"), F.lit(GRAM))).alias("sizes")).first()
    ship = texts.sparkSession.sparkContext.broadcast((*_bitmap(anchors, many["n"]), set(many["sizes"])))
    kind = texts.schema[project].dataType.simpleString()
    # Equal rows have one id; a chance collision within a project only offers values that the search does not find.
    x = spread(texts).withColumn("_id", F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in texts.columns]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        width, bits, sizes = ship.value
        for pdf in batches:
            for at in range(0, len(pdf), 256):  # a bounded stretch of texts at a time
                part = pdf.iloc[at : at + 256]
                row, h = grams(part["t"].tolist(), part["s"].to_numpy(), only=sizes)
                for k in range(len(PROBES)):
                    s = _slots(h, k, width)
                    keep = (bits[s >> 3] >> (s & 7).astype(np.uint8)) & 1 == 1
                    row, h = row[keep], h[keep]
                yield pd.DataFrame({"p": part["p"].to_numpy()[row], "i": part["i"].to_numpy()[row], "h": h.view(np.int64)}).drop_duplicates()

    hits = x.filter(F.length(text) > 0).select(F.col(project).alias("p"), F.col("_id").alias("i"), F.xxhash64(project).alias("s"), F.col(text).alias("t")).mapInPandas(run, f"p {kind}, i long, h long")
    met = hits.alias("x").join(anchors.alias("a"), (F.col("x.h") == F.col("a.h")) & F.col("x.p").eqNullSafe(F.col("a.p"))).select("x.i", F.col("a.p").alias("ap"), F.col("a.v").alias(value), "a.m")
    return x, met.groupBy("i", "ap").agg(F.collect_set(F.struct(value, "m")).alias("_found"))


def _meet(x: DataFrame, found: DataFrame, project: str, how: str) -> DataFrame:
    return x.join(found, (x["_id"] == found["i"]) & x[project].eqNullSafe(found["ap"]), how).drop("_id", "i", "ap")


def _near(found: DataFrame, project: str) -> tuple[DataFrame, Column]:
    """The candidates, written, and which texts may have some, by a bitmap of ids with projects: where few have, the others need not travel."""
    found = cut(found)
    ship = found.sparkSession.sparkContext.broadcast(_bitmap(found.select(F.xxhash64("i", "ap").alias("h")), found.count()))

    def may(i: pd.Series) -> pd.Series:
        (width, bits), h, ok = ship.value, i.to_numpy().view(np.uint64), np.ones(len(i), bool)
        for k in range(len(PROBES)):
            s = _slots(h, k, width)
            ok &= (bits[s >> 3] >> (s & 7).astype(np.uint8)) & 1 == 1
        return pd.Series(ok)

    return found, F.pandas_udf(may, "boolean")(F.xxhash64("_id", project))


def _pairs(found: list) -> list[tuple[str, str]]:
    """Values and what they become, in the order of the mapping."""
    rows = [(m["ord"] is None, m["ord"] or 0, m["step"], r["value"], m["new"]) for r in found for m in r["m"]]
    return [(v, new) for *_, v, new in sorted(rows, key=lambda r: r[:3])]


def _values(items: DataFrame, project: str, restore: bool) -> DataFrame:
    """(project, value, new, ord, step) of a mapping or, with ``restore``, of its inverse: longer forms with a range before bare placeholders."""
    i = items.select(F.col("project_id").alias(project), "ord", "original", "replacement", "placeholder")
    new = F.coalesce(F.nullif("replacement", F.lit("")), "placeholder")
    if not restore:
        return i.select(project, F.col("original").alias("value"), new.alias("new"), "ord", F.lit(0).alias("step")).filter("value <> ''")
    i = i.filter("original is not null")
    ranged = i.filter("replacement <> '' and not (replacement <=> placeholder)").select(project, F.col("replacement").alias("value"), F.col("original").alias("new"), "ord", F.lit(0).alias("step"))
    return ranged.unionByName(i.filter("placeholder <> ''").select(project, F.col("placeholder").alias("value"), F.col("original").alias("new"), "ord", F.lit(1).alias("step")))


def redact(texts: DataFrame, items: DataFrame, project: str, key: str, text: str, restore: bool = False) -> DataFrame:
    """(project, key, text): each text with its project's originals replaced, or, with ``restore``, the placeholders put back."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            new = [t if found is None or not isinstance(t, str) else Replacer(_pairs(found))(t) for t, found in zip(pdf["text"].tolist(), pdf["_found"].tolist())]
            yield pdf[["p", "k"]].assign(text=pd.Series(new, dtype=object, index=pdf.index))

    t = texts.select(F.col(project).alias("p"), F.col(key).alias("k"), F.col(text).alias("text"))
    x = _meet(*_candidates(t, _values(items, "p", restore), "p", "text", "value", ["new", "ord", "step"]), "p", "left")
    schema = f"p {t.schema['p'].dataType.simpleString()}, k {t.schema['k'].dataType.simpleString()}, text string"
    return x.select("p", "k", "text", "_found").mapInPandas(run, schema).toDF(project, key, "text")


def present_values(texts: DataFrame, values: DataFrame, project: str, text: str, value: str) -> DataFrame:
    """(project, value) of the values that stand in at least one text of their project: the contains join."""
    t = texts.select(F.col(project).alias("p"), F.col(text).alias("text")).filter(F.col(text).isNotNull())
    x, found = _candidates(t, values.select(F.col(project).alias("p"), F.col(value).alias("value")).distinct(), "p", "text", "value", [])
    found, near = _near(found, "p")
    here = F.filter("_found.value", lambda v: F.contains("text", v))
    return _meet(x.filter(near), found, "p", "inner").select("p", F.explode(here)).distinct().toDF(project, value)


def redact_runs(runs: list[str], pairs: list[tuple[str, str]]) -> list[str]:
    """The texts of adjoining runs, replaced across their borders: one merge of runs and spans, a replacement where its span begins."""
    spans = claim_spans("".join(runs), sorted(pairs, key=lambda p: -len(p[0])))
    out, begin, k = [], 0, 0
    for run in runs:
        end, kept, new = begin + len(run), begin, []
        while k < len(spans) and spans[k][0] < end:
            a, b, value = spans[k]
            if a >= begin:
                new += [run[kept - begin : a - begin], value]
            kept = max(kept, min(b, end))
            if b > end:
                break
            k += 1
        out.append("".join([*new, run[kept - begin :]]))
        begin = end
    return out


def redact_cells(df: DataFrame, items: DataFrame, project: str, key: str) -> DataFrame:
    """(key, cells): the cells of structured blocks with their texts replaced, in order; blocks of one key count once.

    A block meets the values that its cells can hold together. Blocks that can hold none stay as they are, without a join."""
    ref, text = F.col("cells.ref"), F.col("cells.text")
    b = df.filter("size(structure.cells) > 0").select(F.col(project).alias("p"), F.col(key).alias("k"), F.col("structure.cells").alias("cells")).select("p", "k", ref.alias("refs"), text.alias("texts"), F.array_join(text, "\n").alias("text"))
    x, found = _candidates(b, _values(items, "p", False), "p", "text", "value", ["new", "ord", "step"])
    found, near = _near(found, "p")
    x = x.drop("text").dropDuplicates(["k"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            new = [list(texts) if f is None else list(map(Replacer(_pairs(f)), texts)) for texts, f in zip(pdf["texts"].tolist(), pdf["_found"].tolist())]
            yield pdf[["k", "refs"]].assign(texts=pd.Series(new, dtype=object, index=pdf.index))

    kind = b.schema["k"].dataType.simpleString()
    done = _meet(x.filter(near), found, "p", "left").select("k", "refs", "texts", "_found").mapInPandas(run, f"k {kind}, refs array<string>, texts array<string>")
    done = done.unionByName(x.filter(~near).select("k", "refs", "texts"))
    return done.select(F.col("k").alias(key), F.zip_with("refs", "texts", lambda r, t: F.struct(r.alias("ref"), t.alias("text"))).alias("cells"))
