"""Encoding of a corpus with a public byte-level BPE vocabulary, by speculation and verification.

A greedy longest match proposes tokens for each distinct word. A sequence is what BPE gives exactly when each adjacent pair of its
tokens is what BPE gives for the two tokens' bytes, so the distinct pairs of a batch are tested, in sorted arrays of pairs already
judged; only words with a failing pair are merged exactly, by rank.

Defined results: null and empty texts give an empty list; every row gives one row; strings of special tokens in a text are ordinary
text. Words and pairs that a worker has seen are kept, up to a bound in count, after which the memory starts anew; this changes no
result. Texts are encoded whole.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Where words begin and end in this vocabulary's public description (a fixed value).
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class SpeculativeBpe:
    """Ranks are token ids. ``remember`` bounds the words kept."""

    def __init__(self, path: str, pattern: str = WORD_PATTERN, remember: int = 400_000):
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.bytes_of = {i: t for t, i in self.ranks.items()}
        self.longest: dict[bytes, int] = {}
        for t in self.ranks:
            if len(t) > 1:
                self.longest[t[:2]] = max(self.longest.get(t[:2], 2), len(t))
        self.pattern = regex.compile(pattern)
        self.remember = remember
        self.good = np.zeros(0, np.int64)
        self.bad = np.zeros(0, np.int64)
        self.merged = 0
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.parts: list[np.ndarray] = []
        self.flat = np.zeros(0, np.int32)
        self.starts = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)

    def propose(self, b: bytes) -> list[int]:
        """Greedy longest match."""
        out, i, n, ranks, longest = [], 0, len(b), self.ranks, self.longest
        if (whole := ranks.get(b)) is not None:
            return [whole]
        while i < n:
            k = min(longest.get(b[i : i + 2], 1), n - i)
            while k > 1 and b[i : i + k] not in ranks:
                k -= 1
            out.append(ranks[b[i : i + k]])
            i += k
        return out

    def merge(self, b: bytes) -> list[int]:
        """Exact merging by rank: a heap of adjacent pairs over a linked list."""
        n, ranks = len(b), self.ranks
        if n < 2:
            return [ranks[b]] if n else []
        end, nxt, prev, alive = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(b[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, e = heapq.heappop(heap)
            j = nxt[i] if alive[i] else n
            if j >= n or not alive[i] or end[j] != e:
                continue
            end[i], alive[j], nxt[i] = e, False, nxt[j]
            if nxt[i] < n:
                prev[nxt[i]] = i
                if (x := ranks.get(b[i : end[nxt[i]]])) is not None:
                    heapq.heappush(heap, (x, i, end[nxt[i]]))
            if prev[i] >= 0 and (x := ranks.get(b[prev[i] : e])) is not None:
                heapq.heappush(heap, (x, prev[i], e))
        return [ranks[b[i : end[i]]] for i in range(n) if alive[i]]

    def _judge(self, pairs: np.ndarray) -> np.ndarray:
        """Whether each pair (a << 32 | b) stands as it is when its bytes are merged exactly."""
        found = np.unique(pairs)
        for known in (self.good, self.bad):
            if len(known):
                at = np.minimum(np.searchsorted(known, found), len(known) - 1)
                found = found[known[at] != found]
        if len(found):
            ok = np.fromiter(([a, b] == self.merge(self.bytes_of[a] + self.bytes_of[b]) for a, b in zip((found >> 32).tolist(), (found & 0xFFFFFFFF).tolist())), bool, len(found))
            self.good, self.bad = np.union1d(self.good, found[ok]), np.union1d(self.bad, found[~ok])
        if not len(self.bad):
            return np.ones(len(pairs), bool)
        at = np.minimum(np.searchsorted(self.bad, pairs), len(self.bad) - 1)
        return self.bad[at] != pairs

    def learn(self, words: list[str]) -> None:
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        proposed = [self.propose(b) for b in raw]
        n = np.fromiter(map(len, proposed), np.int64, len(proposed))
        flat = np.fromiter((t for p in proposed for t in p), np.int64, int(n.sum()))
        if len(flat) > 1:
            word = np.repeat(np.arange(len(n)), n)
            inner = word[1:] == word[:-1]
            ok = self._judge((flat[:-1][inner] << 32) | flat[1:][inner])
            for k in np.unique(word[1:][inner][~ok]).tolist():
                proposed[k] = self.merge(raw[k])
                self.merged += 1
        at = len(self.index)
        for k, w in enumerate(words):
            self.index[w] = at + k
        lengths = np.fromiter(map(len, proposed), np.int64, len(proposed))
        self.flat = np.concatenate([self.flat, np.fromiter((t for p in proposed for t in p), np.int32, int(lengths.sum()))])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.starts = np.cumsum(self.lengths) - self.lengths

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of the texts, as of a list array."""
        words, counts, find = [], np.zeros(len(texts), np.int64), self.pattern.findall
        for i, t in enumerate(texts):
            if t:
                w = find(t)
                counts[i] = len(w)
                words += w
        if len(self.index) > self.remember:
            self.forget()
        if new := set(words) - self.index.keys():
            self.learn(list(new))
        at = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        n = self.lengths[at]
        first = np.cumsum(n) - n
        ids = self.flat[np.repeat(self.starts[at] - first, n) + np.arange(int(n.sum()))] if len(at) else np.zeros(0, np.int32)
        ends = np.concatenate([[0], np.cumsum(n)])
        offsets = ends[np.concatenate([[0], np.cumsum(counts)])]
        return offsets, ids


_ready: dict[tuple[str, str], SpeculativeBpe] = {}


def _encoder(path: str, pattern: str) -> SpeculativeBpe:
    if (path, pattern) not in _ready:
        _ready[path, pattern] = SpeculativeBpe(path, pattern)
    return _ready[path, pattern]


def encode(df: DataFrame, key: str, text: str, vocabulary: str = DEFAULT_VOCABULARY, pattern: str = WORD_PATTERN, chars_at_once: int = 4_000_000) -> DataFrame:
    """(key, ids array<int>): one row for each row of ``df``. ``chars_at_once`` bounds what a worker holds at a time, beyond one text."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(vocabulary, pattern)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            i = 0
            while i < len(texts):
                j, size = i, 0
                while j < len(texts) and (j == i or size + len(texts[j] or "") <= chars_at_once):
                    size += len(texts[j] or "")
                    j += 1
                offsets, ids = enc.encode_batch(texts[i:j])
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([keys.slice(i, j - i), lists], ["k", "ids"])
                i = j

    return df.select(df[key].alias("k"), df[text].alias("t")).mapInArrow(run, f"k {kind}, ids array<int>").withColumnRenamed("k", key)
